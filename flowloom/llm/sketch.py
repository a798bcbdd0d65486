"""Bottom-k fingerprints of documents.

A sketch is the ``K`` smallest distinct hashes of a text's five-word shingles. Sketches of parts merge into the sketch
of the whole, and two of them estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from flowloom.llm.common import word_blocks

K = 64
SHINGLE = 5
KNOWN_WORDS = 300_000
FLUSH_BYTES = 8 << 20
_EMPTY = np.zeros(0, dtype=np.uint64)


class WordHashes(dict):
    """Hashes of words, kept for the words seen lately."""

    def __init__(self, limit: int = KNOWN_WORDS):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def _mix(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for column in columns:
        out = (out ^ column) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def sketch(text: str | None, k: int = K, hashes: WordHashes = _HASHES) -> np.ndarray:
    """The ``k`` smallest shingle hashes, ascending. Fewer than five words are one shingle; no words, no shingle."""
    if not text:
        return _EMPTY
    least, tail, any_shingle = _EMPTY, _EMPTY, False
    for words in word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        fresh = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        ids = np.concatenate([tail, fresh]) if tail.size else fresh
        count = len(ids) - SHINGLE + 1
        if count > 0:
            any_shingle = True
            least = merge(least, np.unique(_mix([ids[i:i + count] for i in range(SHINGLE)]))[:k], k)
        tail = ids[-(SHINGLE - 1):]
    if not any_shingle and tail.size:
        return _mix([tail[i:i + 1] for i in range(len(tail))])
    return least


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k] if a.size else b[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of either text that both have; two texts without shingles are alike."""
    if not a.size or not b.size:
        return 1.0 if a.size == b.size else 0.0
    both = np.intersect1d(merge(a, b, k), np.intersect1d(a, b, assume_unique=True), assume_unique=True)
    return both.size / merge(a, b, k).size


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(a.size) if a.size < k else (k - 1) / (float(a[k - 1]) / 2.0 ** 64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if ``a`` has none."""
    if not a.size:
        return 1.0
    together = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * together / distinct(a, k))


def as_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def _in_order(documents: DataFrame) -> DataFrame:
    """``documents`` in descending doc_id order, dealt to tasks by ranges of doc_id: doc_id, text, bucket, borrowed.

    A range also gets the first document of the range that follows it (``borrowed``), so that each of its documents
    meets the next one; at most one such document for each range, whose number the session's shuffle partitions set.
    """
    spark = documents.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = documents.agg(F.percentile_approx("doc_id", shares, 100 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < F.col("doc_id")))
    rows = documents.select("doc_id", "text", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket).alias("bucket"),
                            F.lit(False).alias("borrowed"))
    heads = rows.where("bucket >= 0").groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    lent = [(heads[i - 1]["head"], heads[i]["bucket"]) for i in range(len(heads))]  # the lowest range borrows the first
    small = spark.createDataFrame(lent, "_head bigint, _to int")
    borrowed = documents.join(F.broadcast(small), F.col("doc_id") == F.col("_head")).select(
        "doc_id", "text", F.col("_to").alias("bucket"), F.lit(True).alias("borrowed"))
    return rows.union(borrowed).repartition("bucket").sortWithinPartitions(
        "bucket", "borrowed", F.desc("doc_id"), F.xxhash64("text"), "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their successor. Holds one document and its sketch."""
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shingles",
             "in_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    rows: list[tuple] = []
    held, size = None, 0

    def pair(one, text: str, own: np.ndarray) -> tuple:
        doc_id, before, seen = one
        half = len(before) // 2
        edited = before[:len(before) - half] + text[:half]
        other = sketch(edited)
        return (doc_id, len(before), edited, as_text(seen), as_text(other), resemblance(seen, other),
                resemblance(seen, own), distinct(seen), containment(seen, other))

    place = None
    for batch in batches:
        for doc_id, text, bucket, borrowed in zip(*(batch.column(i) for i in range(4)), strict=True):
            text, bucket, borrowed = text.as_py() or "", bucket.as_py(), borrowed.as_py()
            own = sketch(text)
            if held is not None:
                follows = bucket == place and bucket >= 0
                rows.append(pair(held, text if follows else "", own if follows else _EMPTY))
                size += len(rows[-1][2])
            held, place = None if borrowed else (doc_id.as_py(), text, own), bucket
            if size > FLUSH_BYTES:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
    if held is not None:
        rows.append(pair(held, "", _EMPTY))
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def compare_with_edit(documents: DataFrame) -> DataFrame:
    """Fingerprints of ``documents`` (doc_id, text) and of an edited form of each.

    Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, shingles,
    in_edited. The edited text has its last floor(n / 2) characters replaced by the first as many of the next document, in
    descending doc_id order and round from the last to the first; ``near_*`` estimate the resemblance to the edited text and to the next document,
    ``shingles`` the number of distinct shingles and ``in_edited`` the share of them that the edited text has. NULL
    text is empty. Rows that share a doc_id follow each other by a hash of their text; rows without one have an empty
    text as their next. A table of one row is its own next. The texts are exchanged once.
    """
    return _in_order(documents).mapInArrow(
        _compare, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, shingles double, in_edited double")


_SIGN = np.uint64(1 << 63)


def _partial_sketches(k: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            # signed numbers in the order of the unsigned hashes
            hashes = [(h ^ _SIGN).view(np.int64) for h, _ in held.values()]
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(hashes, pa.list_(pa.int64())),
                                    pa.array([n for _, n in held.values()], pa.int64())], ["part", "hashes", "n"])

        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before, n = held.get(part, (_EMPTY, 0))
                held[part] = merge(before, sketch(text.as_py(), k), k), n + 1
                if len(held) >= limit:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def group_sketches(documents: DataFrame, part: str, k: int = K, limit: int = 10_000) -> DataFrame:
    """One sketch for each value of ``part``, merged from those of its ``documents`` (text and that column).

    Returns the part's value, documents, fingerprint, shingles (estimated number of distinct ones). Tasks merge before
    the exchange, so a part that holds most rows sends ``k`` hashes from each task. NULL is a part of its own.
    """
    fields = documents.schema
    partial = documents.select(F.col(part).cast("string").alias("part"), "text").mapInArrow(
        _partial_sketches(k, limit), "part string, hashes array<long>, n long").checkpoint()
    counts = partial.groupBy("part").agg(F.sum("n").alias("documents"))
    least = Window.partitionBy("part").orderBy("hash")
    kept = partial.select("part", F.explode("hashes").alias("hash")).distinct().withColumn(
        "place", F.row_number().over(least)).where(F.col("place") <= k).groupBy("part").agg(
        F.sort_array(F.collect_list("hash")).alias("hashes")).withColumnRenamed("part", "_part")

    @F.pandas_udf("fingerprint string, shingles double")
    def finish(hashes: pd.Series) -> pd.DataFrame:
        found = [(_EMPTY if h is None else np.array(h, dtype=np.int64).view(np.uint64) ^ _SIGN) for h in hashes]
        return pd.DataFrame({"fingerprint": [as_text(h) for h in found], "shingles": [distinct(h, k) for h in found]})

    joined = counts.join(kept, F.col("part").eqNullSafe(F.col("_part")), "left").withColumn("f", finish("hashes"))
    return joined.select(F.col("part").cast(fields[part].dataType).alias(part), "documents", "f.fingerprint", "f.shingles")
