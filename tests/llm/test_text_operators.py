"""The text operators on small inputs: nulls, empty and long texts, repeated rows, clashing columns, brute force."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from conftest import SF
from flowloom.llm import knn, language, lines, mixing, overlap, pieces, pii, simhash, sketch, stages, tokenfiles, warc
from flowloom.llm.common import components, new_path, prepare, word_blocks
from flowloom.llm.queries import oracle_sql, queries
from tokenizers import Tokenizer

KEY = b"a key for tests"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} and\tmore{i}" for i in range(70_000))
TEXTS = [
    "the first text\nhas three lines of words\nand ends here.", None, "", " \t\n ", "one", "two words", "ÄÖ ß é́ 日本語",
    "the first text\nhas three lines of words\nand ends here.", "12345 678", "<|endoftext|> </s> <unk> ▁x", LONG,
    "the first text\nhas three lines of words\nand stops there.", "\U0001F600 \x00 \x1c \u0085 nbsp x", "a" * 3000,
]
CLASHING = ("size", "code", "copies", "target", "version", "line", "bucket", "ids", "order", "part", "_doc_id", "_text",
            "fingerprint", "component_id", "sid", "edited", "payload", "record_id", "home", "vector", "lang_pred", "_copy")


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s0", None][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[10], (None, "no id here at all", "en", "s1", 3), (None, None, None, None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        made = made.selectExpr("*", f"'x' as `{name}`")
    return made


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


# --- 1


def test_permutations_are_permutations():
    for size in (1, 2, 9, 100, 1000):
        p = pii.Permutation(b"key", "x", size)
        assert sorted(map(p, range(size))) == list(range(size))
        assert all(p.inverse(p(i)) == i for i in range(size))
    large = pii.Permutation(b"key", "x", 16 ** 40)
    assert all(large.inverse(large(i)) == i < 16 ** 40 for i in range(0, 16 ** 40, 16 ** 39 // 7))


def test_pseudonyms_keep_format_and_links():
    text, n = pii.pseudonymise("4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111", KEY)
    assert n == 3 and len({re.sub(r"\D", "", part) for part in re.split(", | and ", text)}) == 1
    digits = re.sub(r"\D", "", text)[:16]
    assert pii.luhn_digit(digits[:-1]) == digits[-1] and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4},.*", text[:25] + text[25:])
    text, n = pii.pseudonymise("DE89370400440532013000", KEY)
    assert n == 1 and pii._iban_rest(text[4:] + text[:4]) == 1 and text.startswith("DE")
    text, n = pii.pseudonymise("on 2024-02-29 or 29.02.2024", KEY)
    moved = re.fullmatch(r"on (\d{4})-(\d\d)-(\d\d) or (\d\d)\.(\d\d)\.(\d{4})", text)
    assert n == 2 and moved[1] == moved[6] and moved[2] == moved[5] and moved[3] == moved[4]
    a, _ = pii.pseudonymise("mail jo.1@mail5.example.com now", KEY)
    b, _ = pii.pseudonymise("jo.1@mail5.example.com", KEY)
    assert a == f"mail {b} now" and re.fullmatch(r"[a-z]{2}\.\d@[a-z]{4}\d\.[a-z]{7}\.com", b) and b[:4] != "jo.1"
    assert pii.pseudonymise("x", b"k") == ("x", 0)
    assert pii.pseudonymise("10.20.30.40", b"k1") != pii.pseudonymise("10.20.30.40", b"k2")


def test_values_that_do_not_validate_stay():
    for text in ("2123465659789240", "version 1.2.300.4", "2023-02-30", "000-12-3456", "", "a" * 500 + " 7" * 400):
        assert pii.pseudonymise(text, KEY) == (text, 0)


def test_pseudonyms_of_all_rows(docs, empty):
    done = pii.protect(docs, KEY)
    assert done.columns == ["doc_id", "text", "n_replaced"]
    assert key((r[0], r[1]) for r in done.collect()) == key((r["doc_id"], pii.pseudonymise(r["text"], KEY)[0] if r["text"]
                                                             is not None else None) for r in docs.collect())
    assert pii.protect(empty, KEY).collect() == []


# --- 2


def test_cards_beside_other_numbers_and_secrets_in_capitals():
    card, value = "4111 1111 1111 1111", "9233A8EC71B04D5F9233A8EC71B04D5F"
    for text in (f"{card} 12/25", f"{card} 123", f"order 7 {card}", f"12 35 {card} 12/25 or", f"{card}-5500-0000-0000-0004"):
        out, count = pii.pseudonymise(text, KEY)
        assert count == 1 + text.count("5500") and card not in out and "5500" not in out
        assert re.sub(r"\d", "0", out) == re.sub(r"\d", "0", text)
        left, right = text.split(card)
        assert out.startswith(left) and (count > 1 or out.endswith(right))
        number = re.sub(r"\D", "", out[len(left):len(left) + len(card)])
        assert pii.luhn_digit(number[:-1]) == number[-1]
    for text in (f'TOKEN = "{value}"', f"Password={value}", f"seen {value} here", f"seen {value.lower()[:16]}{value[16:]} here"):
        out, count = pii.pseudonymise(text, KEY)
        assert count == 1 and value[16:] not in out and len(out) == len(text)
        assert re.search(r"[0-9A-F]{32}" if value in text else r"[0-9A-Fa-f]{32}", out)
    assert pii.pseudonymise("4111 1111 1111 1112 12/25", KEY) == ("4111 1111 1111 1112 12/25", 0)


def test_secrets_dates_and_machines_in_other_words():
    for text, value in (("password: hunter22", "hunter22"), ('"api_key": "a1b2c3d4e5"', "a1b2c3d4e5"), ("born 5 March 1990.", "5 March 1990"),
                        ("on May 17th, 2003 he", "May 17th, 2003"), ("12 FEB 1999", "12 FEB 1999"), ("ping 2001:db8::1 now", "2001:db8::1"),
                        ("fe80::1ff:fe23:4567:890a", "fe80::1ff:fe23:4567:890a"), ("call 030 1234567 now", "030 1234567")):
        out, count = pii.pseudonymise(text, KEY)
        assert count == 1 and value not in out, text
        left, right = text.split(value)
        assert out.startswith(left) and out.endswith(right)
    for text in ("section 12.34.56.78", "Version 1.2.3.4 of", "at 12:34:56 o'clock", "std::abc::def", "secret: a garden", "token: none given",
                 "31 February 2001", "May 2003", "the secret of 2003", "::1 is home", "a ratio of 1:2:3"):
        assert pii.pseudonymise(text, KEY) == (text, 0), text
    moved = [re.search(r"\d{4}", pii.pseudonymise(t, KEY)[0])[0] for t in ("1990-03-05", "5 March 1990", "Mar 5, 1990")]
    assert len(set(moved)) == 1


def test_a_key_is_required_and_counts_whole():
    for key_ in (b"", None):
        with pytest.raises(ValueError):
            pii.pseudonymise("10.20.30.40", key_)
    one, two = (b"k" * 64 + tail for tail in (b"a", b"b"))
    assert pii.pseudonymise("10.20.30.40", one) != pii.pseudonymise("10.20.30.40", two)


def test_long_runs_of_digits_take_linear_time():
    def seconds(text):
        start = time.process_time()
        pii.pseudonymise(text, KEY)
        return time.process_time() - start

    short, long = "1234 5678 9012 3457 " * 4_000, "1234 5678 9012 3457 " * 32_000
    assert seconds(long) < 20 * max(seconds(short), 0.5)


def plain_cards(text):
    """All runs of whole digit groups with 13 to 19 digits that pass the check digit, the most digits first."""
    groups = [m.span() for m in re.finditer(r"\d+", text)]
    found = []
    for i in range(len(groups)):
        for j in range(i, len(groups)):
            digits = "".join(text[a:b] for a, b in groups[i:j + 1])
            odd = [int(c) for c in digits[::-1]]
            total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(odd))
            if 13 <= len(digits) <= 19 and total % 10 == 0 and set(digits) != {"0"}:
                found.append((-len(digits), groups[i][0], groups[j][1]))
    spans = []
    for _, low, high in sorted(found):
        if all(high <= a or b <= low for a, b in spans):
            spans.append((low, high))
    return sorted(spans)


def test_cards_in_runs_of_groups_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        groups = ["".join(map(str, rng.integers(0, 10, rng.integers(1, 6)))) for _ in range(rng.integers(4, 14))]
        text = " ".join(groups)
        match = re.fullmatch(r".*", text)
        assert pii._card_spans(match) == plain_cards(text)


def duck_lines(rows):
    frame = pd.DataFrame([(r["doc_id"], r["text"]) for r in rows], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("given", frame)
    con.execute("create view documents as select doc_id::bigint as doc_id, text::varchar as text from given")
    return [tuple(r) for r in con.execute(lines.ORACLE).fetchall()]


def test_lines_against_sql(spark):
    prepare(spark)
    texts = ["get id 17 from host a1 now\nonly mine at first\nok", "get id 99 from host b2 now\nthe quick brown fox runs far away",
             "the quick brown fox runs far away\nthe quick brown fox walks far away\nok", "get id 5 from host zz now", "",
             None, "a b c d e\na b c d e\nx y", "a b c d f", "\n\n", "  get  id 1 from host c3 now \r\nnew line of text",
             "p q r one two", "p q r six ten"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mine = lines.drop_recurring(rows).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert key(map(tuple, mine)) == key(duck_lines(rows.collect()))
    kept = {r["doc_id"]: r["text"] for r in mine}
    assert kept[0] == texts[0] and kept[1] == "the quick brown fox runs far away" and kept[2] == "ok"
    assert kept[9] == "new line of text" and kept[6] == texts[6] and kept[7] == ""  # the last token varies
    assert kept[10] == texts[10] and kept[11] == texts[11]  # only the leading tokens agree
    shuffled = lines.drop_recurring(rows, broadcast_leaves=0).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert key(map(tuple, shuffled)) == key(map(tuple, mine))


def test_lines_of_all_rows(docs, empty):
    found = lines.drop_recurring(docs).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[7]["text"] == "" and by_id[0]["n_dropped"] == 0 and by_id[1]["text"] is None
    assert by_id[11]["text"] == "and stops there."
    assert by_id[10]["text"] == LONG
    assert lines.drop_recurring(empty).collect() == []


def test_leaf_with_two_templates(spark):
    prepare(spark)
    first = [f"User logged in from desk {w} at noon sharp today" for w in ("a", "b", "c", "d", "e")]
    second = [f"User logged in over the {w} after closing hours yesterday" for w in ("x", "y", "z")]
    alone = "User logged in once more but nobody knows why"
    texts = [t for pair in zip(first, [*second, alone, "ok"], strict=True) for t in pair]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["text"] for r in lines.drop_recurring(rows).collect()} - {""}
    assert kept == {first[0], second[0], alone, "ok"}


def test_leaf_with_three_interleaved_templates(spark):
    """No template fits the lines of a leaf until they are parted by another token."""
    prepare(spark)
    rng, texts = np.random.default_rng(2), []
    kinds = ["the user has now logged in from {} over wire", "the user has just bought {} of our best goods",
             "the user has left room {} without his own key"]
    for i in range(60):
        name = "".join(rng.choice(list("abcdefgh"), 9))
        texts.append(kinds[i % 3].format(name) + f"\nonly line of {name} number x")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mine = lines.drop_recurring(rows).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert key(map(tuple, mine)) == key(duck_lines(rows.collect()))
    assert sum("the user" in r["text"] for r in mine) == 3


def test_line_without_id_yields_to_those_with_one(spark):
    prepare(spark)
    rows = spark.createDataFrame([(None, "one two three"), (4, "one two three"), (None, "other two three")],
                                 "doc_id long, text string")
    assert key((r[0], r["text"]) for r in lines.drop_recurring(rows).collect()) == key(
        [(None, ""), (4, "one two three"), (None, "other two three")])


# --- 3


def test_language_on_held_out_documents(spark):
    found = queries()["op3_language"](spark, SF).toPandas()
    given = pd.read_parquet(f"{SF}/documents.parquet")
    both = found.merge(given, on="doc_id")
    assert len(both) == len(given)
    assert (both.held_out == (both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2))).all()
    tested = both[both.held_out & both.lang.notna() & (both.lang_pred != "und")]
    assert (tested.lang == tested.lang_pred).mean() > 0.95
    assert both.score.between(0, 1).all()


def test_language_of_all_rows(docs, empty):
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    for i, text in enumerate(TEXTS):
        if not any(c.isalpha() for c in text or ""):
            assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0
        else:
            assert found[i]["lang_pred"] in ("en", "de")
    assert language.identify(empty).collect() == []
    nothing = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language.identify(nothing).collect()} == {"und"}


def test_presence_is_read_piece_by_piece(monkeypatch):
    text = "Größe und  Länge, 12 straße!\nEnde " * 40
    whole = language.presence(text)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(language, "PIECE", piece)
        assert (language.presence(text) == whole).all()


# --- 4


def plain_simhash(text):
    words = words_of(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius=3):
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(codes))]


def check_groups(rows, found):
    codes = [plain_simhash(r["text"]) for r in rows]
    roots, least = plain_components(codes), {}
    for r, c in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, 1 << 62), r["doc_id"])
    expected = key((r["doc_id"], f"{code:016x}", least.get(c)) for r, code, c in zip(rows, codes, roots, strict=True))
    assert key(map(tuple, found)) == expected


def test_simhash_groups(spark, docs, empty):
    short = docs.where("text is null or length(text) < 100000")
    found = simhash.near_duplicates(short).select("doc_id", simhash.hexadecimal("code"), "component_id").collect()
    check_groups(short.collect(), found)
    assert simhash.near_duplicates(empty).collect() == []
    check_groups(spark.read.parquet(f"{SF}/documents.parquet").collect(), queries()["op4_simhash"](spark, SF).collect())


def test_long_text_has_the_fingerprint_of_its_words(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    text = LONG[:60_000]
    assert simhash.simhash(text) & 0xFFFFFFFFFFFFFFFF == plain_simhash(text)
    assert [w for block in word_blocks(text.encode(), 500) for w in block] == text.encode().split()


def test_radius_reaches_the_links(spark):
    prepare(spark)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    classes = {r["code"]: r["component_id"] for r in simhash.near_duplicates(given, radius=0).collect()}
    assert len(set(classes.values())) == len(classes)
    with pytest.raises(ValueError):
        simhash.near_duplicates(given, radius=4)


def test_crowded_shards_are_split(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6, dtype=np.int64)]
    codes = {0}
    for b in base:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 9), replace=False)
            codes.add(b ^ sum(1 << int(f) for f in flips))
    codes = sorted(codes)
    frame = spark.createDataFrame([(simhash._signed(c),) for c in codes], "code long")
    for limit in (3, 20, 1000):
        linked = components(simhash.links(frame, shard_rows=limit)).collect()
        mine = {r["node"]: r["root"] for r in linked}
        labels = [mine.get(simhash._signed(c), simhash._signed(c)) for c in codes]
        pairs = Counter(zip(labels, plain_components(codes), strict=True))
        assert len(pairs) == len(set(labels)) == len(set(plain_components(codes)))


def test_components_of_a_chain(spark):
    prepare(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(edges.where("false")).collect() == []


def plain_overlap(texts):
    sets = []
    for text in texts:
        words = words_of(text)
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def check_overlap(rows, found):
    roots, least = plain_overlap([r["text"] for r in rows]), {}
    for r, c in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, 1 << 62), r["doc_id"])
    assert key((r["doc_id"], r["component_id"]) for r in found) == key(
        (r["doc_id"], least.get(c)) for r, c in zip(rows, roots, strict=True))


def test_near_copies_against_brute_force(spark, docs, empty, monkeypatch):
    check_overlap(docs.collect(), overlap.near_copies(docs).collect())
    assert overlap.near_copies(empty).collect() == []
    rng = np.random.default_rng(11)
    texts, common = [], " ".join(f"c{i}" for i in range(30))
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        texts.append(" ".join(words) + " " + common)
        for edits in (1, 2, 3, 4, 5, 6, 8):
            changed = list(words)
            for place in rng.choice(120, edits, replace=False):
                changed[place] = f"e{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(changed) + " " + common)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_overlap(rows.collect(), overlap.near_copies(rows).collect())
    monkeypatch.setattr(overlap, "SAMPLED", 1)  # every shingle is counted, and common ones come last
    monkeypatch.setattr(overlap, "BROADCAST_TEXTS", 0)
    check_overlap(rows.collect(), overlap.near_copies(rows).collect())
    given = spark.read.parquet(f"{SF}/documents.parquet")
    roots, ids = plain_overlap([r["text"] for r in given.collect()]), [r["doc_id"] for r in given.collect()]
    left = {r["doc_id"] for r in stages.drop_near_duplicates(spark, given, SF).collect()}
    assert left == {min(i for i, c in zip(ids, roots, strict=True) if c == root) for root in roots}
    assert len(left) < len({r["component_id"] for r in simhash.near_duplicates(given).collect()})


def test_near_duplicates_of_the_pipeline_go_through_their_fingerprints(spark, monkeypatch):
    prepare(spark)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words) + " ", " ".join([*words, "end"]), "quite another text of a few words", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held, confirmed, inner, confirm = [], [], simhash.links, overlap._confirmed
    monkeypatch.setattr(simhash, "links", lambda codes, *a: held.append({r[0] for r in codes.collect()}) or inner(codes, *a))
    monkeypatch.setattr(overlap, "_confirmed", lambda pairs, *a: confirmed.append(pairs.count()) or confirm(pairs, *a))
    monkeypatch.setattr(overlap, "_met", lambda batches: iter(()))  # nothing meets at a leading shingle
    prints = {simhash.simhash(t) for t in texts}
    assert bin((simhash.simhash(texts[0]) ^ simhash.simhash(texts[2])) & (1 << 64) - 1).count("1") <= simhash.RADIUS
    left = {r["doc_id"] for r in stages.drop_near_duplicates(spark, rows, SF).collect()}
    assert left == {0, 3, 4} and held == [prints] and confirmed == [1, 0]


def test_every_class_keeps_one_row(spark):
    """Rows without an id, different texts under one id, and repeated rows."""
    prepare(spark)
    long = " ".join(f"w{i}" for i in range(40))
    given = [(1, "first text of its own here", "a"), (None, "second text has no id at all", "a"), (None, "third text has none either", "a"),
             (5, "fourth text under number five", "a"), (5, "fifth text under number five too", "b"), (None, long, "z"),
             (9, long, "a"), (8, long + " end", "a"), (8, long + " end", "b"), (8, long + " end", "b"), (None, None, "a"), (None, "", "b")]
    rows = spark.createDataFrame(given, "doc_id long, text string, version string")
    left = stages.drop_near_duplicates(spark, rows, SF)
    assert left.columns == rows.columns
    found = left.collect()
    assert key((r["doc_id"], r["text"] or None) for r in found) == key(
        [(1, given[0][1]), (None, given[1][1]), (None, given[2][1]), (5, given[3][1]), (5, given[4][1]), (8, long + " end"), (None, None)])


def test_parities_never_differ_more_than_their_sets():
    rng = np.random.default_rng(5)
    for size in (0, 1, 60, 64, 65, 500, 900):
        found = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for change in (0, 1, 20, 200):
            other = np.unique(np.append(found[change:], rng.integers(0, 1 << 63, change * 2, dtype=np.uint64)))
            apart = overlap.differing(overlap.parity(found), overlap.parity(other))
            assert apart <= len(np.setxor1d(found, other))


# --- 5


def plain_sketch(text):
    words = words_of(text)
    ids = [np.array([xxhash.xxh64_intdigest(w)], dtype=np.uint64) for w in words]
    if not ids:
        return []
    shingles = [ids[i:i + 5] for i in range(len(ids) - 4)] or [ids]
    return sorted({int(sketch._mix(s)[0]) for s in shingles})[:sketch.K]


def check_edits(rows, found):
    order = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: -r["doc_id"])
    expected = []
    for i, r in enumerate(order):
        text, after = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = (plain_sketch(t) for t in (text, edited, after))

        def near(x, y):
            union = sorted(set(x) | set(y))[:sketch.K]
            return len(set(union) & set(x) & set(y)) / len(union) if x and y else float(not x and not y)

        def count(x):
            return float(len(x)) if len(x) < sketch.K else (sketch.K - 1) / (x[-1] / 2 ** 64)

        both = count(sorted(set(a) | set(b))[:sketch.K])
        inside = min(1.0, near(a, b) * both / count(a)) if a else 1.0
        expected.append((r["doc_id"], len(text), edited, "".join(f"{v:016x}" for v in a),
                         "".join(f"{v:016x}" for v in b), near(a, b), near(a, c), round(count(a), 6), round(inside, 9)))
    assert key((*r[:7], round(r[7], 6), round(r[8], 9)) for r in found) == key(expected)


def test_edits_and_sketches(spark):
    rows = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    check_edits(rows.collect(), sketch.compare_with_edit(rows).collect())
    one = rows.limit(1)
    check_edits(one.collect(), sketch.compare_with_edit(one).collect())


def test_edits_of_all_rows(docs, empty):
    found = sketch.compare_with_edit(docs).collect()
    assert len(found) == docs.count()
    unnamed = [r for r in found if r["doc_id"] is None]
    assert {r["edited"] for r in unnamed} == {"", "no id her"}
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).where("doc_id <> 10")
    check_edits(distinct.collect(), sketch.compare_with_edit(distinct).collect())
    assert sketch.compare_with_edit(empty).collect() == []


def test_sketches_of_groups(docs, empty):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["source"], []).append(r["text"])
    for limit in (1, 10_000):
        found = {r["source"]: r for r in sketch.group_sketches(docs, "source", limit=limit).collect()}
        assert set(found) == set(texts)
        for part, all_texts in texts.items():
            merged = sorted(set().union(*map(plain_sketch, all_texts)))[:sketch.K]
            assert found[part]["documents"] == len(all_texts)
            assert found[part]["fingerprint"] == "".join(f"{v:016x}" for v in merged)
    assert sketch.group_sketches(empty, "source").collect() == []


def test_sketches_merge_and_estimate():
    a = sketch.sketch(" ".join(f"w{i}" for i in range(3000)))
    b = sketch.sketch(" ".join(f"w{i}" for i in range(1500, 4500)))
    assert abs(sketch.resemblance(a, b) - 1 / 3) < 0.2 and abs(sketch.containment(a, b) - 1 / 2) < 0.3
    assert abs(sketch.distinct(a) / 2996 - 1) < 0.4
    both = sketch.merge(a, b)
    assert (both == sketch.merge(b, a)).all() and len(both) == sketch.K
    small = sketch.sketch("a b c d e f")
    assert sketch.distinct(small) == 2 and sketch.containment(small, small) == 1


# --- 6


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def hard_texts():
    rng = np.random.default_rng(5)
    letters = list("abcdeth in   \n▁é漢\U0001F600,.<>0x")
    return [t or "" for t in TEXTS if t != LONG] + ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(800)]


def test_pieces_are_those_of_the_library(library):
    model = pieces.load(pieces.read_model(PIECES))
    for text in hard_texts():
        ids = library.encode(text)
        assert model.encode(text).tolist() == ids
        assert model.decode(ids) == library.decode(ids)
    rng = np.random.default_rng(6)
    for _ in range(1500):
        ids = [int(rng.choice([0, 1, 2, 3 + rng.integers(256), rng.integers(32000), 29871])) for _ in range(rng.integers(8))]
        assert model.decode(ids) == library.decode(ids)


def test_long_chunks_and_small_memory(library):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("theinaors"), 5000)), "ab" * 3000, " " * 3000, "e" * 4000]
    for memory in (pieces.HELD, 1 << 12):
        model = pieces.Pieces(pieces.read_model(PIECES), memory)
        for text in [*texts, *hard_texts(), *texts]:
            assert model.encode(text).tolist() == library.encode(text)
        assert memory == pieces.HELD or len(model) + len(model.older) < 40


def test_pieces_of_all_rows(docs, empty, library):
    model = pieces.read_model(PIECES)
    encoded = pieces.encode_documents(docs, model)
    found = encoded.withColumn("back", pieces.decoded("ids", model)).collect()
    expected = [(r["doc_id"], (ids := library.encode(r["text"] or "") + [2]), library.decode(ids)) for r in docs.collect()]
    assert key((r[0], list(r[1]), r[2]) for r in found) == key(expected)
    assert pieces.encode_documents(empty, model).collect() == []


# --- 7


def test_knn_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    expected = con.execute(oracle_sql()["op7_voronoi_knn"]).fetchall()
    found = queries()["op7_voronoi_knn"](spark, SF)
    assert key(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == key(expected)


def test_bounds_spare_groups_of_clustered_vectors(spark):
    """Where vectors lie in clusters, a query visits few groups; on random directions it visits all."""
    prepare(spark)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16)) * 900
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 25).round().tolist()) for i in range(4000)]
    made = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    for number in (128, 8):
        pivots = knn.choose_pivots(made, number)
        data = knn.assign(made, pivots).toPandas()
        summary = data.groupby("home").agg(radius=("away", "max"), n=("away", "size"),
                                           near=("away", lambda a: sorted(a)[:11])).reset_index()
        asked = knn.visits(made.where("vec_id % 100 = 0"), pivots, summary, 10).toPandas().merge(summary, on="home")
        away = {h: np.sort(g["away"].to_numpy()) for h, g in data.groupby("home")}
        needed = sum(len(away[h]) - np.searchsorted(away[h], d) for h, d in zip(asked["home"], asked["least"], strict=True))
        if number == 128:
            assert asked["n"].sum() < 0.25 * 40 * 4000
        else:  # groups of several clusters: members near the pivot are spared
            assert needed < 0.95 * asked["n"].sum()
    found = {(r["query_id"], r["rank"]): r["score"] for r in knn.top_k(made, made.where("vec_id % 100 = 0"), 10, pivots=128).collect()}
    x = np.array([r[1] for r in rows])
    for q in range(0, 4000, 100):
        best = np.sort(np.delete(x @ x[q], q))[::-1][:10]
        assert [found[q, i] for i in range(1, 11)] == best.astype(int).tolist()


def test_knn_ties_blocks_and_bad_vectors(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 1024]) for i in range(300)] + [(i, [0.0] * 4) for i in range(300, 400)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf")] * 4), (None, [1.0] * 4),
           (904, [1.0, 2.0])]
    given = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as home", "2 as vector")
    vectors = knn.scaled(given.drop("vector", "home"))
    matrix = {i: np.floor(1024 * np.array(np.float32(v), dtype=float)) for i, v in rows}
    expected = []
    for q in range(0, 400, 25):
        scores = sorted((-int(matrix[q] @ v), i) for i, v in matrix.items() if i != q)[:7]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    found = knn.top_k(vectors, vectors.where("vec_id % 25 = 0"), 7, pivots=9, block_rows=13, slice_rows=2)
    assert key(map(tuple, found.collect())) == key(expected)
    few = vectors.where("vec_id < 3")
    assert len(knn.top_k(few, few, 10).collect()) == 6
    assert knn.top_k(vectors.where("false"), vectors, 3).collect() == []


# --- 8


def test_codes_give_any_id():
    rng = np.random.default_rng(2)
    for n in (0, 1, 8, 511, 512, 513, 3000):
        for high in (1 << 8, 1 << 16, 1 << 32):
            ids = rng.integers(0, high, n).astype(np.uint32)
            made = tokenfiles.Codes.of(ids)
            codes = tokenfiles.Codes.from_bytes(memoryview(made.to_bytes()), len(made.levels), n)
            assert [codes.get(i) for i in range(n)] == ids.tolist()
            for a, b in rng.integers(0, n + 1, (20, 2)):
                assert codes.slice(min(a, b), max(a, b)).tolist() == ids[min(a, b):max(a, b)].tolist()
    with pytest.raises(IndexError):
        tokenfiles.Codes.of(np.zeros(2)).get(2)


def test_words_are_those_of_the_library():
    mine, library = tokenfiles.load(tokenfiles.read_tokenizer(WORDS)), Tokenizer.from_file(WORDS)
    for text in hard_texts() + ["It's THE end's", "İstanbul ΣΑΣ ﬁ ½² ª", "don't 're x's's", "a­b"]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_of_all_rows(spark, docs, empty):
    path, library = new_path(spark, "tokens"), Tokenizer.from_file(WORDS)
    tokenfiles.write_tokens(docs, path, tokenfiles.read_tokenizer(WORDS), segment_ids=50)
    rows = tokenfiles.read_tokens(spark, path).join(tokenfiles.file_starts(spark, path), ["part", "number"]).collect()
    rows = sorted(rows, key=lambda r: r["start"] + r["offset"])
    start = 0
    for r in rows:
        assert r["start"] + r["offset"] == start
        start += len(r["ids"]) // 4
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in docs.collect()), key=lambda i: -1 if i is None else i)
    expected = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    assert key((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == key(expected)
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(empty, path, tokenfiles.read_tokenizer(WORDS))
    assert tokenfiles.read_tokens(spark, path).collect() == [] and tokenfiles.file_starts(spark, path).collect() == []


# --- 9


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in open_}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check_mix(rows, found):
    count = Counter()
    for r in rows:
        count[r["source"]] += len(words_of(r["text"]))
    target = plain_targets(count)
    assert key((r["doc_id"], r["source"], len(words_of(r["text"]))) for r in rows) == key(
        (r["doc_id"], r["source"], r["size"]) for r in found)
    taken = Counter()
    for r in found:
        assert r["source_size"] == count[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9, abs=1e-9)
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    return target, taken


def test_mix_of_given_documents(spark):
    rows = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    found = mixing.mix(rows).collect()
    target, taken = check_mix(rows.collect(), found)
    for s in target:
        smallest = min(len(words_of(r["text"])) for r in rows.collect() if r["source"] == s)
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], smallest)
    again = mixing.mix(rows.repartition(7)).collect()
    assert key(map(tuple, again)) == key(map(tuple, found))


def test_mix_of_all_rows(docs, empty):
    given = docs.drop("size", "copies", "target", "sid", "order", "part")
    rows = given.collect()
    target, taken = check_mix(rows, mixing.mix(docs).collect())
    assert mixing.mix(empty).collect() == []
    mixed = mixing.mix(docs)
    grown = mixing.expand(docs, mixed).collect()
    assert len(grown) == mixed.agg({"copies": "sum"}).first()[0] and list(grown[0].asDict()) == docs.columns


def test_rates_meet_their_targets(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    rows = [(s, int(x), int(rng.integers(1, 5))) for s in (1, 2, 3) for x in set(rng.integers(1, 3000, 200))]
    sizes = spark.createDataFrame(rows, "sid int, size long, n long")
    whole = {s: sum(x * n for t, x, n in rows if t == s) for s in (1, 2, 3)}
    goals = {1: 0.05 * whole[1], 2: 2.9 * whole[2], 3: 3.0 * whole[3]}
    targets = spark.createDataFrame([(s, whole[s], float(goals[s])) for s in goals], "sid int, source_size long, target double")
    tilts = {r["sid"]: r for r in mixing.multipliers(sizes, targets).collect()}
    assert set(tilts) == {1, 2}
    for s in (1, 2):
        got = sum(x * n * 3 / (1 + 2 * np.exp(-tilts[s]["tilt"] * x / tilts[s]["scale"])) for t, x, n in rows if t == s)
        assert got == pytest.approx(goals[s], rel=1e-6)
    copies = mixing.group_copies(sizes, targets, mixing.multipliers(sizes, targets)).collect()
    for s in goals:
        assert sum(r["size"] * r["copies"] for r in copies if r["sid"] == s) == pytest.approx(goals[s], rel=0.01)
    assert all(0 <= r["copies"] <= 3 * r["n"] for r in copies)


# --- 10


def test_archives_round_trip(spark):
    prepare(spark)
    mark = "\r\n\r\nWARC/1.1\r\n"
    tails = [mark[i:] + "t" for i in range(5)] + ["h" + mark[:-i] for i in range(1, 5)] + ["WARC/1.1", "\r\nWARC/1.1"]
    same = "equal payload " * 20
    html = [same, None, "", "short", "short", mark * 3 + "x" * 50 + mark, "é" * 5000, same, "y" * 99, "y" * 99, "z" * 100,
            "z" * 100, "a\r\n\r\nb", "\r\n\r\n", LONG[:50_000], *tails]
    rows = [(i, f"http://h/{i}\r\nX: y" if i != 3 else None, h) for i, h in enumerate(html)]
    rows += [rows[0], rows[12], (None, "u", same), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as type")
    for segment in (5, 64, 1 << 20):
        for compression in ("gzip", "none"):
            path = new_path(spark, "warc")
            warc.write_archives(warc.archive_records(pages), path, segment, compression)
            found = warc.read_archives(spark, path).collect()
            expected = []
            for i, _, h in rows:
                data = (h or "").encode()
                equal = [j for j, _, o in rows if j is not None and (o or "") == (h or "")]
                first = min(equal, default=None)
                again = i is not None and len(data) >= 100 and first < i
                expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                                 first if again else None))
            assert all(r["intact"] for r in found)
            assert key((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                       for r in found) == key(expected)
    files = [bytes(r[0]).decode() for r in spark.read.format("binaryFile").option(
        "pathGlobFilter", "part-*").load(path).select("content").collect()]
    text = "".join(files)
    assert len(re.findall("WARC-Type: re", text)) == len(rows) and text.endswith("\r\n\r\n")
    path = new_path(spark, "warc")
    warc.write_archives(warc.archive_records(pages.where("false")), path)
    assert warc.read_archives(spark, path).collect() == []


def test_splits_of_an_archive_lose_nothing(spark):
    prepare(spark)
    pages = spark.range(3000).selectExpr("id as page_id", "'u' as url", "repeat(concat('p', id), cast(id % 90 as int)) as html")
    path = new_path(spark, "warc")
    warc.write_archives(warc.archive_records(pages).coalesce(1), path, compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4099")
    try:
        found = warc.read_archives(spark, path)
        assert found.count() == 3000 and found.where("intact").count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# --- registered


def plain(value):
    if value is None or value is pd.NA or value != value:
        return ""
    return str(int(value)) if isinstance(value, (int, float, np.integer, np.floating)) else str(value)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    mine, theirs = queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(tuple(map(plain, r)) for r in mine[columns].itertuples(index=False)) == sorted(
        tuple(map(plain, r)) for r in theirs[columns].itertuples(index=False))


def test_pipeline_against_brute_force(spark, library):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = [r.asDict() for r in rows if any(c.isalpha() for c in r["text"] or "")]
    left = {r[0]: (r[1], r[3]) for r in duck_lines(kept)}
    kept = [r | {"text": left[r["doc_id"]][0]} for r in kept if left[r["doc_id"]][0] or not left[r["doc_id"]][1]]
    roots = plain_overlap([r["text"] for r in kept])
    first = {}
    for r, c in zip(kept, roots, strict=True):
        first[c] = min(first.get(c, 1 << 62), r["doc_id"])
    kept = [r for r in kept if r["doc_id"] in set(first.values())]
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in kept], "doc_id long, text string, source string")
    mixed = mixing.mix(frame).collect()
    check_mix(kept, mixed)
    text = {r["doc_id"]: r["text"] for r in kept}
    expected = []
    for m in mixed:
        ids = library.encode(text[m["doc_id"]]) + [2]
        row = (m["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
               hashlib.sha256(library.decode(ids).encode()).hexdigest())
        expected += [row] * m["copies"]
    assert key(map(tuple, found)) == key(expected)


def test_stages_return_the_columns_of_documents(spark, docs, empty):
    import corpus_pipeline

    given = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, given, SF).columns == given.columns
        assert stage(spark, given, SF).count() > 0
        assert stage(spark, empty.select(given.columns), SF).count() == 0
