"""What the text operators share: session settings, the shared folder, tables, words, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import new_path, shared_folder

BATCH_ROWS = "1000"
BATCH_BYTES = str(16 << 20)
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch of whole texts may hold, and make sure that there is a shared folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    shared_folder(spark)
    return spark


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read from there, column by column."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, its named columns only."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def word_count(text: Column) -> Column:
    """Number of words in ``text``; NULL counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_blocks(data: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of ``data`` in lists of about ``size`` bytes, so that a very long text needs no list of all its words."""
    start = 0
    while len(data) - start > size:
        cut = _SPACE.search(data, start + size)
        if cut is None:
            break
        yield data[start:cut.start()].split()
        start = cut.end()
    yield data[start:].split()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: bigint): a row (node, root) for every node of an edge.

    ``root`` is the smallest node. Alternates the large-star and small-star steps until nothing changes; each round is
    joins and aggregations over the edges, which are cut from their lineage by ``checkpoint()``.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = edges.checkpoint()
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = small.where("a <> b").distinct().checkpoint()
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
