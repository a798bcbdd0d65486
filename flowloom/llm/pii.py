"""Format-preserving pseudonyms for personal data.

Numbers that validate (card numbers, bank accounts, addresses of machines, telephone and social-security numbers),
dates, mail addresses and secrets are replaced by others of the same format. A keyed Feistel network permutes all
values of a format, so equal values get equal pseudonyms in every document, whatever their punctuation, and different
values stay different; check digits are made anew, dates stay dates. Every function takes the key, which is the caller's
secret.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from ipaddress import IPv6Address

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROUNDS = 8
MARGIN = 96
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_SENSITIVE = StructType([StructField("text", StringType()), StructField("n_replaced", LongType())])


def checked_key(key: bytes) -> bytes:
    """The key as the permutations take it. One is required; of a long key, a digest of all of it counts."""
    if not key:
        raise ValueError("a key is required: without one, pseudonyms could be undone by anybody")
    return key if len(key) <= 64 else blake2b(key).digest()


class Permutation:
    """A keyed permutation of the numbers below ``size``: Feistel rounds on a rectangle, walked until inside."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size, self.left = size, max(1, int(size ** 0.5) if size < 1 << 40 else 1 << (size.bit_length() // 2))
        self.right = -(-size // self.left)
        self.base = blake2b(f"{kind}|{size}".encode(), key=checked_key(key), digest_size=16)
        self.reach = max(self.left, self.right).bit_length() // 8 + 9

    def _value(self, turn: int, half: int) -> int:
        state = self.base.copy()
        state.update(turn.to_bytes(1, "big") + half.to_bytes(self.reach, "big"))
        digest = state.digest()
        while len(digest) < self.reach:
            digest += blake2b(digest, digest_size=16).digest()
        return int.from_bytes(digest[:self.reach], "big")

    def _once(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for turn in range(ROUNDS):
            if turn % 2:
                b = (b + self._value(turn, a)) % self.right
            else:
                a = (a + self._value(turn, b)) % self.left
        return a * self.right + b

    def _back(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for turn in reversed(range(ROUNDS)):
            if turn % 2:
                b = (b - self._value(turn, a)) % self.right
            else:
                a = (a - self._value(turn, b)) % self.left
        return a * self.right + b

    def __call__(self, x: int) -> int:
        while (x := self._once(x)) >= self.size:
            pass
        return x

    def inverse(self, x: int) -> int:
        while (x := self._back(x)) >= self.size:
            pass
        return x


@lru_cache(4096)
def _permutation(key: bytes, kind: str, size: int) -> Permutation:
    return Permutation(key, kind, size)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT_OF = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_HEX = "0123456789abcdef"


def permute_text(key: bytes, kind: str, value: str, alphabet: str | None = None) -> str:
    """``value`` permuted among the texts that have the same kind of character (or ``alphabet``) at each place."""
    number, size = 0, 1
    for c in value:
        letters = alphabet if alphabet and c in alphabet else _DIGIT_OF.get(c, (None, 0))[0]
        if letters:
            number, size = number * len(letters) + letters.index(c), size * len(letters)
    if size == 1:
        return value
    shape = "".join(alphabet[0] if alphabet and c in alphabet else _DIGIT_OF[c][0][0] if c in _DIGIT_OF else c for c in value)
    number, out = _permutation(key, f"{kind}|{shape}", size)(number), []
    for c in reversed(value):
        letters = alphabet if alphabet and c in alphabet else _DIGIT_OF.get(c, (None, 0))[0]
        if letters:
            number, place = divmod(number, len(letters))
            c = letters[place]
        out.append(c)
    return "".join(reversed(out))


def _refill(form: str, fresh: str) -> str:
    """``form`` with its letters and digits, in order, those of ``fresh``."""
    left = iter(fresh)
    return "".join(next(left) if c.isascii() and c.isalnum() else c for c in form)


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` and it a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c)
        if i % 2 == 0:
            value = value * 2 - 9 * (value > 4)
        total += value
    return str(-total % 10)


def _card(key: bytes, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
        return None
    payload = permute_text(key, "card", digits[:-1])
    return _refill(found, payload + luhn_digit(payload))


def _card_spans(found: re.Match) -> list[tuple[int, int]]:
    """Where in a run of digit groups the card numbers lie: whole groups, the most digits first, none in another."""
    run = found[0]
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    fitting = []
    for i, (start, _) in enumerate(groups):
        size = 0
        for low, stop in groups[i:i + 19]:
            size += stop - low
            if size > 19:
                break
            if size >= 13:
                fitting.append((-size, start, stop))
    taken = [False] * len(groups)  # spans are whole groups, so those that overlap share one
    number = {start: i for i, (start, _) in enumerate(groups)}
    spans: list[tuple[int, int]] = []
    for _, start, stop in sorted(fitting):
        first = last = number[start]
        while last + 1 < len(groups) and groups[last + 1][1] <= stop:
            last += 1
        if taken[first] or taken[last] or any(taken[first:last]):
            continue
        digits = re.sub(r"\D", "", run[start:stop])
        if luhn_digit(digits[:-1]) == digits[-1] and digits.strip("0"):
            spans.append((start, stop))
            taken[first:last + 1] = [True] * (last + 1 - first)
    return [(found.start() + start, found.start() + stop) for start, stop in sorted(spans)]


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _account(key: bytes, found: str) -> str | None:
    compact = re.sub(r"\s", "", found)
    if _iban_rest(compact[4:] + compact[:4]) != 1:
        return None
    body = permute_text(key, "account" + compact[:2], compact[4:])
    return _refill(found, f"{compact[:2]}{98 - _iban_rest(body + compact[:2] + '00'):02d}{body}")


def _machine(key: bytes, found: str) -> str | None:
    parts = [int(p) for p in found.split(".")]
    if max(parts) > 255:
        return None
    number = _permutation(key, "machine", 1 << 32)(int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, number.to_bytes(4, "big")))


def _telephone(key: bytes, found: str) -> str | None:
    start = re.match(r"\+\d{1,3}(?=\D)", found)
    head = start[0] if start else ""
    digits = re.sub(r"\D", "", found[len(head):])
    if not 7 <= len(digits) <= 14:
        return None
    return head + _refill(found[len(head):], permute_text(key, "telephone", digits))


def _social(key: bytes, found: str) -> str | None:
    area, group, serial = found.split("-")
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return None
    number = _permutation(key, "social", 898 * 99 * 9999)(
        ((int(area) - 1 - (area > "666")) * 99 + int(group) - 1) * 9999 + int(serial) - 1)
    number, serial_out = divmod(number, 9999)
    area_out, group_out = divmod(number, 99)
    return f"{area_out + 1 + (area_out >= 665):03d}-{group_out + 1:02d}-{serial_out + 1:04d}"


def _date(key: bytes, found: str) -> str | None:
    parts = re.split(r"(\D)", found)
    year_first = len(parts[0]) == 4
    for day, month in ((4, 2),) if year_first else ((0, 2), (2, 0)):
        year = 0 if year_first else 4
        try:
            ordinal = date(int(parts[year]), int(parts[month]), int(parts[day])).toordinal()
        except ValueError:
            continue
        if _FIRST_DAY <= ordinal <= _LAST_DAY:
            moved = date.fromordinal(_FIRST_DAY + _permutation(key, "date", _LAST_DAY - _FIRST_DAY + 1)(ordinal - _FIRST_DAY))
            parts[year], parts[month], parts[day] = f"{moved.year:04d}", f"{moved.month:02d}", f"{moved.day:02d}"
            return "".join(parts)
    return None


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _written_date(key: bytes, found: str) -> str | None:
    """A date with its month as an English word; the same permutation of days as dates in numbers."""
    day, name, year = re.search(r"\d{1,2}(?!\d)", found), re.search(r"[A-Za-z]{3,}", found), re.search(r"\d{4}", found)
    short = len(name[0]) == 3
    month = next(i for i, m in enumerate(_MONTHS, 1) if m[:3].lower() == name[0][:3].lower())
    try:
        ordinal = date(int(year[0]), month, int(day[0])).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= ordinal <= _LAST_DAY:
        return None
    moved = date.fromordinal(_FIRST_DAY + _permutation(key, "date", _LAST_DAY - _FIRST_DAY + 1)(ordinal - _FIRST_DAY))
    word = _MONTHS[moved.month - 1][:3 if short else None]
    word = word.upper() if name[0].isupper() else word
    fresh = {day.span(): str(moved.day), name.span(): word, year.span(): f"{moved.year:04d}"}
    out, at = [], 0
    for low, high in sorted(fresh):
        out += [found[at:low], fresh[low, high]]
        at = high
    return "".join([*out, found[at:]])


def _machine_6(key: bytes, found: str) -> str | None:
    try:
        number = int(IPv6Address(found))
    except ValueError:
        return None
    return str(IPv6Address(_permutation(key, "machine 6", 1 << 128)(number))) if number > 1 else None


def _mail(key: bytes, found: str) -> str | None:
    name, _, place = found.rpartition("@")
    labels, _, top = place.rpartition(".")
    return f"{permute_text(key, 'mail', name)}@{permute_text(key, 'mail place', labels)}.{top}"


def _secret(key: bytes, found: str) -> str | None:
    alphabet = None
    if re.fullmatch(r"[0-9A-Fa-f]{16,}", found):
        alphabet = _HEX if found == found.lower() else _HEX.upper() if found == found.upper() else _HEX + "ABCDEF"
    return permute_text(key, "secret", found, alphabet)


#: Kinds in the order in which they are tried at a place; each function says None where the value doesn't validate.
KINDS: dict[str, tuple[str, Callable[[bytes, str], str | None]]] = {
    "mail": (r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,6}[A-Za-z]{2,24}", _mail),
    # after a colon, only what has a digit; after an equals sign, anything
    "named": (r"(?i:(?<![A-Za-z0-9])(?:password|passwd|token|api[_-]?key|secret))[\"']?"
              r"(?: ?= ?\"(?P<quoted>[^\s\"]{4,})|=(?P<plain>[^\s\"'<>,;]{4,})|: ?[\"']?(?P<listed>(?=[^\s\"'<>,;]*\d)[^\s\"'<>,;]{6,}))",
              _secret),
    "access": (r"(?<=(?<![A-Za-z0-9])AKIA)[0-9A-Z]{16}(?![A-Za-z0-9])", _secret),
    "hexadecimal": (r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])", _secret),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _account),
    "machine": (r"(?<![\w.])(?<!ection )(?<!hapter )(?<!ersion )(?<!§ )(?<!Nr\. )\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", _machine),
    "machine 6": (r"(?<![\w:.])(?=[0-9A-Fa-f]{0,3}\d[0-9A-Fa-f]{0,3}:)[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?::(?!\w))?(?![\w:])"
                  r"|(?<![\w:.])(?=[0-9A-Fa-f]{0,3}\d[0-9A-Fa-f]{0,3}:)[0-9A-Fa-f]{1,4}(?:(?::[0-9A-Fa-f]{1,4}){0,5}::)(?![\w:])", _machine_6),
    "written date": (r"(?<!\w)(?:\d{1,2}(?:st|nd|rd|th|\.)? (?:%s) \d{4}|(?:%s) \d{1,2}(?:st|nd|rd|th)?, \d{4})(?!\w)"
                     % ((_WORDS := "|".join(w for m in _MONTHS for w in (m, m.upper(), m[:3], m[:3].upper()))), _WORDS), _written_date),
    "date": (r"(?<![\w.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?:(?![\w-])|(?=T\d))", _date),
    "social": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _social),
    "card": (r"(?<![\w])\d(?:[ -]?\d){12,}(?![\w])", _card),
    "telephone": (r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)"
                  r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
                  r"|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"
                  r"|(?<![\w+./-])0[1-9]\d{1,3}[ /-]\d{6,8}(?![\w-])", _telephone),
}
_HINT = re.compile(r"[0-9@]|(?i:password|passwd|token|api[_-]?key|secret)[\"']? ?[=:]")
#: Kinds whose pattern finds a run that can hold several values, or values beside something else.
_SPANS: dict[str, Callable[[re.Match], list[tuple[int, int]]]] = {
    "card": _card_spans, "named": lambda found: [found.span(found.lastgroup)]}
_SEARCHES = {name: (re.compile(pattern), replace, _SPANS.get(name, lambda found: [found.span()]))
             for name, (pattern, replace) in KINDS.items()}


def _windows(text: str):
    """Stretches around every digit, at sign and secret's name, from white space to white space; they hold all finds."""
    start = stop = -1
    for hint in _HINT.finditer(text):
        at = hint.start()
        if at + MARGIN <= stop:
            continue
        low, high = max(0, at - MARGIN), min(len(text), at + 2 * MARGIN)
        while low > 0 and not text[low - 1].isspace():
            low -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        if start >= 0 and low <= stop:
            stop = max(stop, high)
        else:
            if start >= 0:
                yield start, stop
            start, stop = low, high
    if start >= 0:
        yield start, stop


def pseudonymise(text: str, key: bytes) -> tuple[str, int]:
    """``text`` with pseudonyms, and how many values were replaced. A replaced value isn't searched again."""
    key, out, done, count = checked_key(key), [], 0, 0
    for start, stop in _windows(text):
        out.append(text[done:start])
        parts: list[tuple[str, bool]] = [(text[start:stop], False)]
        for search, replace, spans in _SEARCHES.values():
            fresh: list[tuple[str, bool]] = []
            for part, fixed in parts:
                if fixed:
                    fresh.append((part, True))
                    continue
                at = 0
                for low, high in (span for found in search.finditer(part) for span in spans(found)):
                    other = replace(key, part[low:high])
                    if other is None:
                        continue
                    fresh += [(part[at:low], False), (other, True)]
                    at = high
                    count += 1
                fresh.append((part[at:], False))
            parts = fresh
        out += [part for part, _ in parts]
        done = stop
    out.append(text[done:])
    return "".join(out), count


def pseudonyms(text: Column | str, key: bytes) -> Column:
    """A struct (text, n_replaced); NULL text stays NULL with nothing replaced. ``key`` is required."""
    key = checked_key(key)

    @F.pandas_udf(_SENSITIVE)
    def run(values: pd.Series) -> pd.DataFrame:
        done = [(None, 0) if v is None else pseudonymise(v, key) for v in values]
        return pd.DataFrame({"text": [d[0] for d in done], "n_replaced": [d[1] for d in done]})

    return run(text)


def protect(documents: DataFrame, key: bytes) -> DataFrame:
    """``documents`` (doc_id, text) with pseudonyms: doc_id, text, n_replaced. Rows are independent of each other."""
    return documents.select("doc_id", pseudonyms("text", key).alias("p")).select("doc_id", "p.text", "p.n_replaced")
