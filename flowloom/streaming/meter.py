"""Flow metering on a packet stream, whatever order its packets come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowloom.functions import folds, tracking, waiting
from flowloom.operators.features import capture_windows, finish_flows, flow_records, sum_flows
from flowloom.operators.packets import KEY, canonical
from flowloom.operators.segment import FLOW_TIMEOUT, IDLE_THRESHOLD, symbol
from flowloom.streaming import late, ordered

register_pickle_by_value(folds)
register_pickle_by_value(tracking)
register_pickle_by_value(waiting)
register_pickle_by_value(ordered)
register_pickle_by_value(late)


def _start(writer, interval: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def meter_batches(packets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  interval: str | None = "2 seconds", policy: str = "open") -> StreamingQuery:
    """Each batch is a capture of its own: its packets become flows, and flows never span batches.

    ``policy='open'`` emits what is still open at the end of the capture.  The flow table of a batch is
    recomputed from its packets, so a replayed batch gives the same flows.
    """
    def meter(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # hot keys are counted before the packets are metered
        try:
            sink(flow_records(batch, policy=policy), batch_id)
        finally:
            batch.unpersist()

    return _start(packets.writeStream.foreachBatch(meter).option("checkpointLocation", checkpoint), interval)


def meter_windows(packets: DataFrame, seconds: int = 2, policy: str = "all") -> DataFrame:
    """Flows that never span a capture interval of packet time: the batch form of ``meter_batches``, whose
    result does not depend on how packets were batched."""
    return flow_records(capture_windows(packets, seconds), within=["capture_window"], policy=policy,
                        hot_rows=None).withColumn("window_start_us", F.col("capture_window") * seconds * 1_000_000)


def _labelled_schema(fields: list) -> T.StructType:
    return T.StructType(fields + [T.StructField(n, T.StructType.fromDDL(f"x {t}")[0].dataType)
                                  for n, _, t in folds.LABELS])


def _metered(packets: DataFrame, make: Callable[[list], tuple[T.StructType, type]], lateness: str, timeout: int, idle: int,
             skew: int, width: int) -> DataFrame:
    if width < skew:
        raise ValueError("a slice must be at least as long as a clock may run back")
    keyed = (canonical(packets).withColumn("symbol", symbol()).drop("srcip", "srcport", "dstip", "dstport")
             .withColumn("chunk", F.lit(0).cast("bigint"))
             .withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", lateness))
    fields = [f for f in keyed.schema.fields if f.name != "event_time"]
    out, kind = make(fields)
    # an expired flow and a late packet have few values
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    meter = kind(KEY, T.StructType(fields), out, timeout, idle, skew, width)
    # without the watermark's column the operator sees late rows too
    return keyed.select(*[f.name for f in fields]).groupBy(*KEY).transformWithStateInPandas(
        meter, T.StructType([*out, T.StructField("late", T.StringType())]), "append", "EventTime")


def segment_stream(packets: DataFrame, timeout: int = FLOW_TIMEOUT, idle: int = IDLE_THRESHOLD,
                   lateness: str = "10 minutes", skew: int = ordered.SKEW, width: int = ordered.WIDTH) -> DataFrame:
    """``segment`` on a stream: packets may come in any order within ``lateness`` and are taken by their numbers.

    A packet waits in the state until the watermark says that no earlier one of its key can come; a clock may run back
    by ``skew`` microseconds. A key that has been silent for longer than the timeout leaves the state, after a row that
    says its flow expired. A packet that comes too late is a row of its own, with the packet as JSON in ``late``.
    """
    return _metered(packets, lambda fields: (_labelled_schema(fields), ordered.Segmenter), lateness, timeout, idle, skew, width)


def flow_stream(packets: DataFrame, timeout: int = FLOW_TIMEOUT, idle: int = IDLE_THRESHOLD,
                lateness: str = "10 minutes", skew: int = ordered.SKEW, width: int = ordered.WIDTH) -> DataFrame:
    """Flow records of a packet stream, and late packets: each flow leaves when it closes or times out.

    Packets wait as in ``segment_stream``. The state of a key is its waiting packets, its machine and the sums of its open
    flow, a few hundred numbers however long the flow is. A flow that only silence ends leaves once the watermark is past
    its timeout. ``late`` is NULL for flows, and the packet as JSON for rows that stand for a late packet.
    """
    nothing = packets.sparkSession

    def make(fields: list) -> tuple[T.StructType, type]:
        rows = nothing.createDataFrame([], _labelled_schema(fields))
        return sum_flows(rows, idle=idle).schema, ordered.FlowSummer

    sums = _metered(packets, make, lateness, timeout, idle, skew, width)
    return finish_flows(sums, ["late"])


def _store(stream: DataFrame, path: str, checkpoint: str, interval: str | None, rejects: str | None,
           partitions: int | None) -> StreamingQuery:
    """Store a metered stream in a folder for each batch; a replay rewrites its own."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.where("late is null").drop("late").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            if rejects:
                batch.where("late is not null").select(F.col("late").alias("packet")).write.mode("overwrite").parquet(
                    f"{rejects}/batch={batch_id}")
        finally:
            batch.unpersist()

    with late.state_partitions(stream.sparkSession, partitions):
        return _start(stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), interval)


def run_meter(packets: DataFrame, path: str, checkpoint: str, interval: str | None = "2 seconds",
              lateness: str = "10 minutes", rejects: str | None = None,
              partitions: int | None = None, **limits) -> StreamingQuery:
    """Store segmented packets as their turn comes; ``flow_statistics`` over the stored table gives the flows.

    Packets that come too late are stored under ``rejects``. The state is kept in ``partitions`` parts.
    """
    return _store(segment_stream(packets, lateness=lateness, **limits), path, checkpoint, interval, rejects, partitions)


def run_flow_meter(packets: DataFrame, path: str, checkpoint: str, interval: str | None = "2 seconds",
                   lateness: str = "10 minutes", rejects: str | None = None,
                   partitions: int | None = None, **limits) -> StreamingQuery:
    """Store the flows of a packet stream as they end, and packets that come too late under ``rejects``."""
    return _store(flow_stream(packets, lateness=lateness, **limits), path, checkpoint, interval, rejects, partitions)
