"""Sinks: scored documents, evaluation results, console. ``commits`` has those that appear together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.dashboards import blocklist


def write_messages(messages: DataFrame, options: Mapping[str, str], fmt: str = "kafka") -> None:
    """Batch write of ``value`` messages to a topic (or to text files with ``fmt='text'``)."""
    writer = messages.select("value").write.format(fmt).options(**options)
    (writer.mode("append") if fmt != "kafka" else writer).save()


UNBATCHED = -1


def write_scored(scored: DataFrame, path: str, batch_id: int | None = None, fmt: str = "parquet",
                 options: Mapping[str, str] | None = None) -> None:
    """Store scored flows: a folder for each batch, by day within it.

    A replayed batch overwrites its whole folder, whatever day its rows carry by then; rows without a batch are
    appended.  ``read_scored`` prunes days.  ``fmt`` and ``options`` select a search-index connector where one
    is installed.
    """
    dated = scored.withColumn("day", F.to_date("timestamp"))
    batch = UNBATCHED if batch_id is None else batch_id
    (dated.write.format(fmt).options(**(options or {})).option("partitionOverwriteMode", "static").partitionBy("day")
     .mode("append" if batch_id is None else "overwrite").save(f"{path}/batch={batch}"))


def read_scored(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored scored flows with ``since <= timestamp < until`` (UTC text); reads the folders of those days only."""
    stored = spark.read.parquet(path)
    for bound, after in ((since, True), (until, False)):
        if bound is not None:
            at = F.lit(bound).cast("timestamp")
            stored = stored.filter((F.col("day") >= F.to_date(at)) & (F.col("timestamp") >= at) if after else
                                   (F.col("day") <= F.to_date(at)) & (F.col("timestamp") < at))
    return stored.drop("batch", "day")


def write_blocklist(scored: DataFrame, path: str, batch_id: int) -> None:
    """Pairs to block, one directory per batch; replaying a batch rewrites its own directory."""
    blocklist(scored).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Evaluation results, a row or a few."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_rejects(rejects: DataFrame, path: str, batch_id: int) -> None:
    """Messages that could not be read, one directory per batch like the blocklist's."""
    rejects.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def debug_console(stream: DataFrame, checkpoint: str, rows: int = 20) -> StreamingQuery:
    """Print each batch of a stream."""
    return (stream.writeStream.format("console").option("numRows", rows)
            .option("checkpointLocation", checkpoint).start())
