"""Capture files: classic pcap containers to raw frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions import pcap
from flowloom.schema import FRAME_SCHEMA
from flowloom.session import shared_folder

register_pickle_by_value(pcap)

CAPTURE_SCHEMA = "capture string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FRAME_SCHEMA)


def _stretches(spark: SparkSession, paths: str | Sequence[str], span: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths).select("path", "length").filter("length > 0")
    parts = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(length - 1) div {span}"))))
    probed = parts.withColumn("span", F.lit(span).cast("bigint")).repartition("path", "part").mapInArrow(
        pcap.probe_stretches, "path string, length bigint, part bigint, stop bigint, guess bigint, count bigint, "
        "after bigint, cut boolean")
    return probed.repartition("path").sortWithinPartitions("path", "part").mapInArrow(
        pcap.number_stretches, "path string, begin bigint, stop bigint, first bigint, cut_at bigint, records bigint")


def read_captures(spark: SparkSession, paths: str | Sequence[str], span: int = pcap.STRETCH, rotated: bool = False) -> DataFrame:
    """Frames of pcap files: ``capture`` (file), ``num`` (record number in it, from 1), ``ts``, ``frame``.

    Only the file listing goes through the driver.  Files are cut into stretches of ``span`` bytes.  Each stretch
    finds, on its own, where its first record seems to begin and counts from there; one row per stretch is then
    put together per file, where a wrong guess is noticed and mended.  No task reads a whole file, frames are
    streamed.  With ``rotated``, the files of a folder are one capture in the order of their names, whose record numbers
    go on from file to file.  ``capture`` belongs in ``within`` when flows must not span files.
    """
    found = _stretches(spark, paths, span)
    if rotated:
        shared_folder(spark)
        found = found.checkpoint()  # a row for each stretch, read twice
        before = Window.partitionBy(F.regexp_extract("path", "^(.*)/", 1)).orderBy("path").rowsBetween(
            Window.unboundedPreceding, -1)
        files = found.groupBy("path").agg(F.sum("records").alias("n")).select(
            "path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        found = found.join(files, "path").withColumn("first", F.col("first") + F.col("before")).drop("before")
    return found.select("path", "begin", "stop", "first").repartition("path", "first").mapInArrow(
        pcap.read_stretches, CAPTURE_SCHEMA)


def cut_captures(spark: SparkSession, paths: str | Sequence[str], span: int = pcap.STRETCH) -> DataFrame:
    """Files that end within a record: ``capture`` and the ``offset`` of that record."""
    return _stretches(spark, paths, span).filter("cut_at is not null").select(
        F.col("path").alias("capture"), F.col("cut_at").alias("offset"))
