"""Spelling variants: each word's form is the far commoner word one edit away.

Words that are one edit apart are found with asymmetric chunks. A word is cut into two disjoint chunks; the other word
of a pair contributes the positional grams those chunks can be. One edit touches one chunk only, so the other is a gram of
the other word, at the same place if the edit is behind it and shifted by the difference in length if it is before; that
pair of places is all the join needs, and the words that meet are verified. A chunk that more than ``GROUP`` words share
is extended: of the part in which the edit must lie, one half is a chunk again. So a word meets a bounded number of others
however many share its first letters, and no pair is lost: the last extensions leave a single place open, which the
alphabet bounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words shorter than this, and words seen less often, have no variants.
MIN_LENGTH, MIN_COUNT = 7, 2
#: One in so many (document, word) pairs loses a letter before words are counted.
DAMAGED = 31
#: A form is at least so many times as common as its variant.
RATIO = 10
GROUP = 32
#: Up to this many shared chunks (8 bytes each, at least ``GROUP`` rows each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CHUNKS = 2_000_000
_HELD_WORDS = 200_000
_BLOCK = 1 << 22
_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")


def _blocks(text: str) -> Iterator[str]:
    """``text`` in pieces of about ``_BLOCK`` characters that cut no word."""
    start = 0
    while len(text) - start > _BLOCK:
        gap = _GAP.search(text, start + _BLOCK)
        if gap is None:
            break
        yield text[start:gap.start()]
        start = gap.end()
    yield text[start:]


def _lower(text: str) -> str:
    return text.encode().lower().decode()  # A-Z only


def document_words(doc_id: int | None, text: str | None) -> Counter:
    """Occurrences of a document's words of at least ``MIN_LENGTH`` letters, after the damage."""
    runs: Counter = Counter()
    for block in _blocks(text or ""):
        runs.update(_RUN.findall(_lower(block)))
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for word, n in runs.items():
        if len(word) >= MIN_LENGTH:
            h = zlib.crc32(word.encode(), seed)
            if h % DAMAGED == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < MIN_LENGTH:
                    continue
            found[word] += n
    return found


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.update(document_words(doc_id, text.as_py()))
            if len(held) >= _HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


def count_words(documents: DataFrame) -> DataFrame:
    """Words of ``documents`` (doc_id, text) and how often they occur: word, n. Tasks add up before the exchange."""
    partial = documents.select("doc_id", "text").mapInArrow(_partial_counts, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _placed(rows: DataFrame) -> DataFrame:
    """Adds ``key``: what is outside of the open part [low, high) of the shorter word, ``size`` letters long.

    ``longer`` (0 or 1) letters more are open in a word that is longer by one.
    """
    before = F.substring("word", F.lit(1), F.col("low"))
    after = F.substring("word", F.col("high") + F.col("longer") + 1, F.col("size"))
    return rows.withColumn("key", F.xxhash64("size", "low", "high", before, after))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: one half of the open part is a chunk, and the edit lies in the other."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    parts = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")),
                    F.struct(middle.alias("low"), F.col("high").alias("high")))
    split = rows.select("word", "n", "size", "longer", F.explode(parts).alias("part"))
    return _placed(split.select("word", "n", "size", "longer", "part.low", "part.high"))


def _chunks(words: DataFrame, group: int, broadcast_chunks: int) -> DataFrame:
    """Rows (key, word, n, size, longer, low, high), few of them with one key."""
    length = F.char_length("word")
    roles = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")).withColumn(
        "size", length - F.col("longer"))
    rows = _halved(roles.withColumns({"low": F.lit(0), "high": F.col("size")})).checkpoint()
    done = None
    while True:
        splits = F.col("high") - F.col("low") > 1
        common = rows.where(splits).groupBy("key").count().where(F.col("count") > group).select(
            "key", F.lit(True).alias("common")).checkpoint()
        number = common.count()
        if not number:
            return rows if done is None else done.unionByName(rows)
        marked = rows.join(F.broadcast(common) if number <= broadcast_chunks else common, "key", "left")
        shared = F.col("common").isNotNull() & splits
        few = marked.where(~shared).select(*rows.columns)
        done = few if done is None else done.unionByName(few)
        rows = _halved(marked.where(shared)).checkpoint()


def near_words(words: DataFrame, group: int = GROUP, broadcast_chunks: int = BROADCAST_CHUNKS) -> DataFrame:
    """Pairs of ``words`` (word, n; each word once) that are exactly one edit apart: a, n_a, b, n_b, each pair once.

    ``a`` is the shorter word, or the first in code-point order of two of equal length.
    """
    rows = _chunks(words, group, broadcast_chunks).checkpoint()
    one = rows.where("longer = 0").select("key", "size", "low", "high", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    # a pair may meet in several places; the open part in which the words first differ reports it
    here = (F.col("high") == F.col("size")) | (
        F.substring("a", F.lit(1), F.col("high")) != F.substring("b", F.lit(1), F.col("high")))
    met = one.join(other, "key").where((F.col("longer") == 1) | (F.col("a") < F.col("b"))).where(
        (F.char_length("a") + F.col("longer") == F.char_length("b")) & here
        & (F.levenshtein("a", "b", 1) == 1) & (F.substring("a", F.lit(1), F.col("low")) == F.substring("b", F.lit(1), F.col("low"))))
    return met.select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """The end of each word's chain of ``forms`` (word, form): word, root. Each step doubles the way that is known.

    A form is ``RATIO`` times as common as its word, so there are no circles and chains are short.
    """
    known = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        further = known.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        known_next = known.join(further, known["root"] == further["_word"], "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")).checkpoint()
        known = known_next.select("word", "root")
        if known_next.where("moved").isEmpty():
            return known


def variants(documents: DataFrame, ratio: int = RATIO, group: int = GROUP, broadcast_chunks: int = BROADCAST_CHUNKS) -> DataFrame:
    """Words of ``documents`` (doc_id, text) with their commoner spelling: word, form, root, n, n_near, form_n.

    Near words are one inserted, deleted or replaced letter apart. ``form`` is the commonest near word (of ties the first
    in code-point order) if it occurs at least ``ratio`` times as often; ``root`` follows forms to the last and is the
    word itself where there is none. NULL and letterless texts have no words; a row without doc_id counts as one whose
    id is the empty text; repeated rows count again; an empty table gives no rows.
    """
    words = count_words(documents).checkpoint()
    near = near_words(words, group, broadcast_chunks)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionAll(
        near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    top: Column = -F.col("best.less")
    is_form = top >= F.col("n") * ratio
    rows = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, top).alias("form_n")).checkpoint()
    roots = _roots(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
with table_of as (
  select list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as crc
  from (select unnest(range(256)) as i)),
r as (
  select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents where text is not null),
d as (select id, run, count(*) as n from r where length(run) >= 7 group by all),
b as (select id, run, n, hex(encode(id || ':' || run)) as h from d),
c as (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2),
    lambda i: ('0x' || h[i:i+1])::bigint)), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) as h
  from b, table_of),
w as (
  select case when h % 31 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from c),
v as (select word, sum(n)::bigint as n from w where length(word) >= 7 group by word having sum(n) >= 2),
e as (
  select word, n, unnest(range(length(word) + 1)) as place from v),
k as (
  select word, n, place, case when place = 0 then word else word[1:place - 1] || word[place + 1:] end as key from e),
p as (
  select distinct a.word as word, b.word as other, b.n as other_n
  from k a join k b on a.key = b.key and a.word <> b.word and (a.place = b.place or a.place = 0 or b.place = 0)),
g as (
  select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from p group by word),
f as (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when other_n >= 10 * v.n then other end as form,
    case when other_n >= 10 * v.n then other_n end::bigint as form_n
  from v left join g on v.word = g.word)
select f0.word, f0.form, coalesce(f3.form, f2.form, f1.form, f0.form, f0.word) as root, f0.n, f0.n_near, f0.form_n
from f f0 left join f f1 on f0.form = f1.word left join f f2 on f1.form = f2.word left join f f3 on f2.form = f3.word"""
