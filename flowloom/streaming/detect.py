"""Streaming detection: decode, score, enrich and store flow messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.dashboards import blocklist, panel_partials
from flowloom.operators.geo import add_locations
from flowloom.plans.model import score
from flowloom.plans.versions import Models
from flowloom.schema import MODEL_FIELDS
from flowloom.sources import growing as growing_files
from flowloom.sources.commits import Store, day_of
from flowloom.sources.growing import GrowingLines, read_growing
from flowloom.sources.flows import decode_wire, wire_rejects
from flowloom.sources.sinks import write_blocklist, write_rejects, write_scored

register_pickle_by_value(growing_files)

BATCH_INTERVAL = "1 second"


def read_flow_stream(spark: SparkSession, fmt: str, options: Mapping[str, str], path: str | None = None) -> DataFrame:
    """Messages as a stream with a STRING ``value``: ``kafka`` (needs the connector package), ``text``, or
    ``growing_lines`` for files that are appended to."""
    spark.dataSource.register(GrowingLines)
    stream = spark.readStream.format(fmt).options(**options).load(*([path] if path else []))
    return stream.select(F.col("value").cast("string").alias("value"))


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def relay_lines(spark: SparkSession, source: str, sink: str, checkpoint: str, fmt: str = "text",
                options: Mapping[str, str] | None = None, interval: str | None = None,
                growing: bool = False) -> StreamingQuery:
    """Relay each line of a directory, unchanged and from the beginning, to a topic or to text files.

    With ``growing``, files are followed while they grow; without, each is complete when it appears.
    """
    lines = read_growing(spark, source) if growing else spark.readStream.text(source)
    target = {"path": sink} if fmt != "kafka" else {"topic": sink}
    writer = (lines.writeStream.format(fmt).options(**target, **(options or {}))
              .option("checkpointLocation", checkpoint))
    return _trigger(writer, interval).start()


def score_flows(flows: DataFrame, model: PipelineModel | Column, ranges: DataFrame, at: Column | None = None,
                features: Sequence[str] = MODEL_FIELDS) -> DataFrame:
    """Scored documents of typed flows.  ``model`` is a fitted pipeline or a prediction expression."""
    scored = (flows.withColumn("predict", model) if isinstance(model, Column) else score(model, flows, features))
    return add_locations(scored, ranges).withColumn("timestamp", F.current_timestamp() if at is None else at)


def score_messages(messages: DataFrame, model: PipelineModel | Column, ranges: DataFrame,
                   at: Column | None = None) -> DataFrame:
    """One stateless plan from messages to scored documents, for batches and streams alike; messages that are
    no flow records are left to ``wire_rejects``."""
    return score_flows(decode_wire(messages), model, ranges, at)


def run_detection(messages: DataFrame, model: PipelineModel | Column, ranges: DataFrame, store: str,
                  checkpoint: str, blocked: str | None = None, interval: str | None = BATCH_INTERVAL,
                  at: Column | None = None, rejects: str | None = None,
                  features: Sequence[str] = MODEL_FIELDS) -> StreamingQuery:
    """Start detection.  Sinks are keyed by batch, so a batch replayed after a failure is not doubled.
    ``rejects`` is where messages go that are no flow records.  ``interval=None`` drains what is there and
    stops."""
    def store_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        scored = score_flows(decode_wire(batch), model, ranges, at, features).persist()
        try:
            write_scored(scored, store, batch_id)
            if blocked:
                write_blocklist(scored, blocked, batch_id)
            if rejects:
                write_rejects(wire_rejects(batch), rejects, batch_id)
        finally:
            scored.unpersist()
            batch.unpersist()

    writer = messages.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def run_committed(messages: DataFrame, model: PipelineModel | Column, ranges: DataFrame, path: str, checkpoint: str,
                  interval: str | None = BATCH_INTERVAL, at: Column | None = None,
                  features: Sequence[str] = MODEL_FIELDS) -> StreamingQuery:
    """Detection whose sinks (scored, blocked, rejects, panels) appear together or not at all, in a ``Store`` at ``path``."""
    store = Store(messages.sparkSession, path)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        if not store.committed(batch_id):
            commit_batch(store, batch, model, ranges, batch_id, at, features)

    writer = messages.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def commit_batch(store: Store, batch: DataFrame, model: PipelineModel | Column, ranges: DataFrame, batch_id: int,
                 at: Column | None = None, features: Sequence[str] = MODEL_FIELDS, version: int | None = None) -> None:
    """Score a batch of messages and store all that comes of it in one commit."""
    batch.persist()
    scored = score_flows(decode_wire(batch), model, ranges, at, features).persist()
    dated = day_of(scored if version is None else scored.withColumn("model_version", F.lit(version)))
    try:
        store.commit(batch_id, {
            "scored": store.stage(dated, "scored", batch_id, ["day"]),
            "blocked": store.stage(blocklist(scored), "blocked", batch_id),
            "rejects": store.stage(wire_rejects(batch), "rejects", batch_id),
            "panels": store.stage(panel_partials(scored).coalesce(1), "panels", batch_id)})
    finally:
        scored.unpersist()
        batch.unpersist()


def run_versioned(messages: DataFrame, models: Models, run: str, ranges: DataFrame, path: str, checkpoint: str,
                  interval: str | None = BATCH_INTERVAL, at: Column | None = None,
                  features: Sequence[str] = MODEL_FIELDS) -> StreamingQuery:
    """``run_committed`` with the newest of ``models`` in each batch; rows say which version scored them."""
    store = Store(messages.sparkSession, path)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        if not store.committed(batch_id):
            version = models.of_batch(run, batch_id)
            commit_batch(store, batch, models.load(version), ranges, batch_id, at, features, version)

    writer = messages.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def windowed_counts(scored: DataFrame, interval: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Attacks, normal flows, bytes and packet sums per bucket of a scored stream; later rows than
    ``lateness`` are dropped and finished buckets leave the state."""
    return (scored.withWatermark("timestamp", lateness)
            .groupBy(F.window("timestamp", interval).alias("w"))
            .agg(F.count_if(F.col("predict") == 1).alias("attacks"),
                 F.count_if(F.col("predict") == 0).alias("normal"),
                 F.sum("total_fpackets").alias("fpackets"), F.sum("total_bpackets").alias("bpackets"),
                 F.sum("total_bvolume").alias("rx_bytes"), F.sum("total_fvolume").alias("tx_bytes"))
            .select(F.col("w.start").alias("bucket"), "*").drop("w"))
