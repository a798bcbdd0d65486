"""Late rows of a stream as rows of their own, instead of losing them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

@contextmanager
def state_partitions(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """A stream started within has its state in so many partitions, which its checkpoint then fixes; None leaves the
    session's number of shuffle partitions."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        if partitions is not None:
            spark.conf.set(name, str(partitions))
        yield
    finally:
        spark.conf.set(name, before)


def _mark_late(batch: DataFrame, batch_id: int, time: str, wait: timedelta, marks: str) -> DataFrame:
    """The rows of ``batch`` with ``late``. The latest time up to each batch is stored under ``marks`` and read by the next, so
    a batch that is repeated is compared with the same time."""
    latest = F.unix_millis(F.max(time))
    if batch_id > 0:
        before = batch.sparkSession.read.parquet(f"{marks}/batch={batch_id - 1}").head()[0]
        latest = F.greatest(latest, F.lit(before).cast("bigint"))
    else:
        before = None
    batch.agg(latest.alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
    late = F.lit(False) if before is None else F.coalesce(
        F.unix_millis(time) < before - wait // timedelta(milliseconds=1), F.lit(False))
    return batch.withColumn("late", late)


def run_sorter(stream: DataFrame, time: str, kept: str, late: str, checkpoint: str, lateness: str = "10 minutes",
               interval: str | None = "2 seconds") -> StreamingQuery:
    """Store rows in time under ``kept`` and late ones under ``late``, a folder for each batch; a replay rewrites its own.

    A row is late if timestamp ``time`` lies more than ``lateness`` before the latest time of earlier batches. No row is
    lost; a row without a time is not late. The rows need no state: what a batch has to know is one number.
    """
    wait = stream.sparkSession.sql(f"select interval {lateness}").head()[0]

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            marked = _mark_late(batch, batch_id, time, wait, f"{checkpoint}/latest")
            marked.where("not late").drop("late").write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
            marked.where("late").drop("late").write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
