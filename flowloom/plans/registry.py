"""Every operator as a named query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import dashboards, evaluate, features, packets, prepare, select, windows
from flowloom.operators.geo import add_locations
from flowloom.operators.segment import segment
from flowloom.plans import model as models
from flowloom.plans import versions
from flowloom.plans.scoring import rule_predict, scored_flows
from flowloom.schema import KEY_FIELDS, MODEL_FIELDS, PACKET_SCHEMA, RECORD_FIELDS, WIRE_FIELDS
from flowloom.session import new_path
from flowloom.session import prepare as prepare_session
from flowloom.sources.captures import read_captures
from flowloom.sources.commits import Store, day_of
from flowloom.sources.fixtures import NESTED_RANGES, geo_ranges, packets_from_events
from flowloom.sources.flows import decode_wire, encode_wire, read_flows, wire_rejects, write_flows
from flowloom.sources.growing import open_folder
from flowloom.sources.pcapfiles import write_captures
from flowloom.sources.sinks import read_scored, write_metrics, write_scored
from flowloom.streaming import detect, late, meter

FLOW_COLUMNS = [*RECORD_FIELDS, "flow_start", "start_us", "last_us", "bursts", "status"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

Query = Callable[[SparkSession, str], DataFrame]


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(prepare_session(spark), sf_dir)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.flow_records(_packets(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_flows(_flows(spark, sf_dir), geo_ranges(spark))


def _listed(flows: DataFrame) -> DataFrame:
    return flows.select(*[c for c in ("capture_window",) if c in flows.columns], *FLOW_COLUMNS,
                        F.col("is_valid").cast("int").alias("is_valid"))


def _r6(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


def _scaled(name: str) -> list[Column]:
    """A value of any magnitude as digits and power of ten."""
    power = F.when(F.col(name) > 0, F.floor(F.log10(name))).otherwise(0)
    return [power.cast("int").alias(f"{name}_power"), F.round(F.col(name) / F.pow(F.lit(10.0), power), 5).alias(f"{name}_digits")]


def _bucket() -> Column:
    return F.unix_seconds("bucket").alias("bucket")


def _labelled(flows: DataFrame) -> DataFrame:
    """The registered queries call a flow an alert when nothing came back."""
    return flows.withColumn("class", F.when(F.col("total_bpackets") > 0, "0").otherwise("1"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("quality").cast("double").alias("label"), (1 - F.col("toxic")).cast("double").alias("prediction"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.encode_frames(_packets(spark, sf_dir))


def _decoded(frames: DataFrame) -> DataFrame:
    return packets.decode_frames(frames).select(*PACKET_SCHEMA.names)


def _encapsulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRE around every other frame, NSH around the rest."""
    inner = F.col("frame").substr(F.lit(15), F.length("frame"))
    gre = F.concat(F.lit(bytes(12) + b"\x08\x00\x45" + bytes(8) + b"\x2f" + bytes(10)), F.lit(b"\x20\x00\x08\x00"),
                   F.lit(bytes(4)), inner)
    nsh = F.concat(F.lit(bytes(12) + b"\x89\x4f\x00\x02\x01\x01\x00\x00\x00\x00"), inner)
    wrapped = _frames(spark, sf_dir).withColumn("frame", F.when(F.col("num") % 2 == 0, gre).otherwise(nsh))
    return _decoded(packets.strip_encapsulation(wrapped, "gre").unionByName(
        packets.strip_encapsulation(wrapped, "nsh")))


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _frames(spark, sf_dir).withColumn("frame", F.when(
        F.col("num") % 10 == 3, F.col("frame").substr(1, 20)).otherwise(F.col("frame")))
    return packets.short_frames(cut).select("num", "reason")


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with more variety in their headers than flows need."""
    num = F.col("num")
    varied = _packets(spark, sf_dir).select(
        "*", (num % 96 + 32).cast("int").alias("ttl"),
        (F.when(num % 5 == 0, 16384).otherwise(0) + F.when(num % 23 == 0, num % 100 + 8192).otherwise(0))
        .alias("fragment"), (num % 9).alias("icmp_type"), (num % 4).alias("icmp_code"))
    varied = varied.withColumn("flags", F.col("flags") + F.when(num % 7 == 0, 64).when(num % 11 == 0, 128).otherwise(0))
    varied = varied.withColumn("prhlen", F.when(F.col("proto") == 6, 20).otherwise(F.col("prhlen")))
    return varied.withColumn("proto", F.when(num % 19 == 0, 1).otherwise(F.col("proto")))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.decode_headers(packets.encode_frames(_varied(spark, sf_dir)))


def _plain_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``_headers`` gives, without going through frames."""
    icmp, tcp, c = F.col("proto") == 1, F.col("proto") == 6, F.col
    return _varied(spark, sf_dir).select(
        "num", (c("ts_us") / 1000000 * 1000000).cast("bigint").alias("ts_us"), "srcip", "dstip", "proto",
        (c("dscp") * 4).alias("tos"), "ttl", c("iphlen").alias("header_len"), "len",
        F.shiftright("fragment", 14).bitwiseAND(F.lit(1)).alias("df"),
        F.shiftright("fragment", 13).bitwiseAND(F.lit(1)).alias("mf"),
        c("fragment").bitwiseAND(F.lit(8191)).alias("fragment_offset"),
        *[F.when(~icmp, c(n)).alias(n) for n in ("srcport", "dstport")], F.when(tcp, 5).alias("data_offset"),
        F.when(tcp, c("flags")).alias("flags"), *[F.when(icmp, c(n)).alias(n) for n in ("icmp_type", "icmp_code")])


def _traffic(windowed: DataFrame) -> DataFrame:
    out = windows.traffic_characteristics(windowed)
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("mean_") else F.col(c) for c in out.columns])


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment(_packets(spark, sf_dir)).filter(~F.col("expires"))
    return rows.select(
        "num", "flow_start", F.when(F.col("side") == F.col("front"), "f").otherwise("b").alias("dir"), "gap", "iat",
        "burst_no", F.col("closes").cast("int").alias("closes"))


def _expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packets(spark, sf_dir)
    now = rows.agg(F.max("ts_us").alias("now")).select("now").scalar()
    return features.expire_idle(features.flow_records(rows), now).select("flow_start", "srcip", "dstip", "last_us")


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_wire(_flows(spark, sf_dir), "live")


def _flow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "flow-csv")
    write_flows(prepare.add_class(_flows(spark, sf_dir)), path)
    return read_flows(spark, path)


def _relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "relay")
    _wire(spark, sf_dir).write.text(f"{base}/in")
    detect.relay_lines(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.text(f"{base}/out")


def _grow(lines: DataFrame, folder: str, share: float) -> int:
    """Write a file for each partition of ``lines`` up to ``share`` of its bytes; returns how many files there are."""
    def write(batches):
        data = b"".join(v.as_py().encode() + b"\n" for batch in batches for v in batch.column(0))
        if data:
            system, inner = open_folder(folder)
            system.create_dir(inner)
            with system.open_output_stream(f"{inner}/{TaskContext.get().partitionId()}.log") as out:
                out.write(data[:int(len(data) * share)])
            yield pa.record_batch([pa.array([1])], ["n"])

    return lines.mapInArrow(write, "n long").count()


def _relay_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one relay: files are first cut off within a line, then whole."""
    base = new_path(spark, "growing")
    lines = _wire(spark, sf_dir).select("value").repartition(4, "value").sortWithinPartitions("value")
    for share in (0.6, 1.0):
        _grow(lines, f"{base}/in", share)
        detect.relay_lines(spark, f"{base}/in", f"{base}/out", f"{base}/state", growing=True).awaitTermination()
    return spark.read.text(f"{base}/out")


def _cells(df: DataFrame, keep: Sequence[str], array: Column) -> DataFrame:
    return df.select(*keep, F.posexplode(array).alias("idx", "value"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.named_features(_flows(spark, sf_dir)).select(
        "flow_start", F.explode("document").alias("name", "value"))


def _weights(spark: SparkSession, sf_dir: str, heuristic: str = "variance_ratio") -> DataFrame:
    return select.feature_weights(_flows(spark, sf_dir), MODEL_FIELDS, heuristic)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINE_FEATURES)


def _corr(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", (F.round("corr", 6) + 0.0).alias("corr"))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_locations(_flows(spark, sf_dir), geo_ranges(spark)).select(
        "flow_start", "srcip", "dstip", F.col("srclocation.lat").alias("src_lat"),
        F.col("srclocation.lon").alias("src_lon"), F.col("dstlocation.lat").alias("dst_lat"),
        F.col("dstlocation.lon").alias("dst_lon"))


def _document(scored: DataFrame) -> DataFrame:
    return scored.select("flow_start", "srcip", "dstip", "total_fvolume", F.col("dstlocation.lat").alias("dst_lat"),
                         F.col("dstlocation.lon").alias("dst_lon"), "predict",
                         F.unix_millis("timestamp").alias("timestamp_ms"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scored")
    write_scored(_scored(spark, sf_dir), path)
    return read_scored(spark, path).select("flow_start", "srcip", "dstip", "predict",
                                           F.unix_millis("timestamp").alias("timestamp_ms"))


def _series(table: DataFrame, *rounded: str) -> DataFrame:
    return table.select(_bucket(), *[F.round(c, 6).alias(c) if c in rounded else F.col(c)
                                     for c in table.columns if c != "bucket"])


def _map(table: DataFrame) -> DataFrame:
    return table.select(*[c for c in table.columns if c not in ("lat", "lon")], *_r6("lat", "lon"))


def _trained(spark: SparkSession, sf_dir: str):
    flows = _labelled(_flows(spark, sf_dir)).checkpoint()  # metered once, for training and testing
    training, testing = models.keyed_split(flows, [*KEY_FIELDS, "flow_start"])
    return models.train(training), testing


def _predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, testing = _trained(spark, sf_dir)
    predictions, _ = models.evaluate(model, testing)
    return predictions


def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "model")
    model = models.get_model(path, _labelled(_flows(spark, sf_dir)))
    again = models.get_model(path, _labelled(_flows(spark, sf_dir)))
    return models.describe_model(spark, again).withColumn(
        "same_rules", F.lit(models.tree_of(model).toDebugString.split("\n", 1)[1]) ==
        F.lit(models.tree_of(again).toDebugString.split("\n", 1)[1]))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape and rules of the tree that two splits must give, stored and loaded, and what it says of each kind of flow.

    It learns from captures of two seconds: the longer a datagram flow, the likelier a DSCP that is not zero, and whole
    tables may have no other, where one split would do.
    """
    held = versions.Models(spark, new_path(spark, "described"))
    held.publish(_offline(spark, sf_dir, meter.meter_windows(_packets(spark, sf_dir)))[0])
    model = held.load(held.current())
    shape = models.describe_model(spark, model).select("nodes", "depth", F.array_join(F.array_sort("indices"), ",").alias("indices"))
    kinds = _flows(spark, sf_dir).groupBy("proto", (F.col("dscp") == 0).cast("int").alias("no_dscp")).agg(
        F.min("dscp").alias("dscp"), F.count(F.lit(1)).alias("flows"))
    ruled = kinds.withColumn("predicted", models.rules_column(model, SIMPLE_FEATURES))
    return ruled.select("proto", "no_dscp", "flows", "predicted").join(F.broadcast(shape))


def _jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, some of them with a clock an hour ahead."""
    ahead = F.when(F.col("num") % 1688 == 800, 3_600_000_000).otherwise(0)
    return _packets(spark, sf_dir).withColumn("ts_us", F.col("ts_us") + ahead)


def _damaged(spark: SparkSession, sf_dir: str, metered: DataFrame | None = None) -> DataFrame:
    """Wire messages, some of them cut, garbled or without class."""
    number = F.col("flow_start")
    broken = (F.when(number % 17 == 3, F.concat(F.substring("value", 1, 40), F.lit('"')))
              .when(number % 17 == 7, F.concat(F.lit('"x'), F.replace("value", F.lit('"'), F.lit(",9")), F.lit('"')))
              .when(number % 17 == 11, F.replace("value", F.lit('"'), F.lit("")))
              .when(number % 17 == 13, F.replace("value", F.lit(',live"'), F.lit(',"'))))
    flows = _flows(spark, sf_dir) if metered is None else metered
    return encode_wire(flows, "live", keep=["flow_start", "proto"]).withColumn(
        "value", F.coalesce(broken, "value"))


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.when((F.col("proto") == 6) & (F.col("num") % 9 == 0), 32).otherwise(0)
    return _packets(spark, sf_dir).withColumn("flags", (F.col("flags") + urgent).cast("int"))


def _unwanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, some of them of another protocol, of another version, or cut."""
    frame, kind = F.col("frame"), F.col("num") % 10
    rest = frame.substr(F.lit(15), F.length("frame"))
    return _frames(spark, sf_dir).withColumn("frame", F.when(
        kind == 3, F.concat(frame.substr(1, 12), F.lit(b"\x86\xdd"), rest)).when(
        kind == 5, F.concat(frame.substr(1, 14), F.lit(b"\x65"), rest.substr(F.lit(2), F.length("frame")))).when(
        kind == 7, F.concat(frame.substr(1, 23), F.lit(b"\x01"), frame.substr(F.lit(25), F.length("frame")))).when(
        kind == 9, frame.substr(1, 36)).otherwise(frame))


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch stored, and stored again after midnight."""
    path, scored = new_path(spark, "replayed"), _scored(spark, sf_dir)
    write_scored(scored, path, 7)
    write_scored(scored.withColumn("timestamp", F.col("timestamp") + F.expr("interval 1 day")), path, 7)
    return read_scored(spark, path).select("flow_start", "srcip", "dstip", "predict",
                                           F.unix_millis("timestamp").alias("timestamp_ms"))


STORED_RANGE = ("2024-01-01 00:00:00", "2024-01-01 02:00:00")


def _stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scored")
    write_scored(_scored(spark, sf_dir), path, 0)
    return read_scored(spark, path, *STORED_RANGE)


SIMPLE_FEATURES = ["proto", "dscp"]


def _offline(spark: SparkSession, sf_dir: str, metered: DataFrame | None = None):
    """Features with so few values that every split is tried, and a label that two splits give."""
    alert = (F.col("proto") == 6) & (F.col("dscp") == 0)
    metered = _flows(spark, sf_dir) if metered is None else metered
    flows = metered.withColumn("class", F.when(alert, "1").otherwise("0"))
    return models.offline_run(flows, [*KEY_FIELDS, "flow_start"], features=SIMPLE_FEATURES, k=2)


def _offline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "metrics")
    write_metrics(_offline(spark, sf_dir)[2], path)
    return spark.read.json(path).select(
        *_r6("accuracy", "precision", "recall", "f_measure", "test_error"), F.col("rows").cast("bigint").alias("rows"))


def _rules_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _labelled(_flows(spark, sf_dir))
    training, testing = models.keyed_split(flows, [*KEY_FIELDS, "flow_start"])
    model = models.train(training)
    both = model.transform(models.labelled(testing)).withColumn("by_rule", models.rules_column(model))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("flows"), F.count_if(
        F.col("by_rule") != F.col("prediction")).alias("mismatches"))


def _stream_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "detect-model")
    _flows(spark, sf_dir).write.parquet(f"{base}/flows")  # metered once, for the model and for the messages
    flows = spark.read.parquet(f"{base}/flows")
    model = _offline(spark, sf_dir, flows)[0]
    _damaged(spark, sf_dir, flows).select("value").repartition(4).write.text(f"{base}/in")
    messages = detect.read_flow_stream(spark, "text", {"maxFilesPerTrigger": "2"}, f"{base}/in")
    detect.run_detection(messages, model, geo_ranges(spark), f"{base}/store", f"{base}/state", interval=None,
                         rejects=f"{base}/rejects", features=SIMPLE_FEATURES).awaitTermination()
    good = read_scored(spark, f"{base}/store").select("duration", "predict")
    bad = spark.read.parquet(f"{base}/rejects").agg(F.count(F.lit(1)).alias("rejected"))
    return good.groupBy("predict").agg(F.count(F.lit(1)).alias("flows"), F.sum("duration").alias("duration")).join(
        F.broadcast(bad))


def _stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "detect")
    _wire(spark, sf_dir).repartition(4).write.text(f"{base}/in")
    messages = detect.read_flow_stream(spark, "text", {"maxFilesPerTrigger": "2"}, f"{base}/in")
    detect.run_detection(messages, rule_predict(), geo_ranges(spark), f"{base}/store", f"{base}/state",
                         blocked=f"{base}/blocked", interval=None).awaitTermination()
    return read_scored(spark, f"{base}/store").select(
        *KEY_FIELDS, "duration", "total_fvolume", "predict", F.col("dstlocation.lat").alias("dst_lat"),
        F.col("dstlocation.lon").alias("dst_lon"))


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as three captures, each in files for ranges of its frames, and read back with their record numbers."""
    base, frames = new_path(spark, "captures"), _frames(spark, sf_dir)
    for part in range(3):
        share = frames.filter(F.col("num") % 3 == part).repartitionByRange("num").sortWithinPartitions("num")
        write_captures(share, f"{base}/{part}")
    found = read_captures(spark, f"{base}/*/*.pcap", span=1 << 16, rotated=True)
    return found.select(F.regexp_extract("capture", r"/(\d)/[^/]*$", 1).cast("int").alias("part"), F.col("num").alias("record"),
                        F.round(F.col("ts") * 1_000_000).cast("long").alias("ts_us"),
                        F.octet_length("frame").alias("length"), F.md5("frame").alias("digest"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = add_locations(_flows(spark, sf_dir), geo_ranges(spark, NESTED_RANGES))
    return found.select("flow_start", "srcip", "dstip", F.col("srclocation.lat").alias("src_lat"),
                        F.col("dstlocation.lat").alias("dst_lat"))


def _committed(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """Wire messages in four batches, each stored in one commit; the third is killed between its sinks and comes again."""
    store, messages = Store(spark, new_path(spark, "store")), _wire(spark, sf_dir)
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("duration") % 86_400_000_000 * 2)
    for batch in range(4):
        share = messages.filter(F.pmod(F.xxhash64("value"), F.lit(4)) == batch).persist()
        if batch == 2:
            store.stage(day_of(detect.score_messages(share, rule_predict(), geo_ranges(spark), at)), "scored", batch, ["day"])
        detect.commit_batch(store, share, rule_predict(), geo_ranges(spark), batch, at)
        share.unpersist()
    return store, messages


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, messages = _committed(spark, sf_dir)
    again = messages.filter(F.pmod(F.xxhash64("value"), F.lit(4)) == 1)
    detect.commit_batch(store, again, rule_predict(), geo_ranges(spark), 1, F.current_timestamp())  # committed before
    for upto in (1, 2):
        store.compact(upto, {"scored": ["day"]}, {"scored": ["day", "timestamp"]})
    return store.read("scored").select(*KEY_FIELDS, "duration", "predict", F.to_date("timestamp").cast("string").alias("day"))


def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview from what four batches stored of their flows."""
    store, scored = Store(spark, new_path(spark, "panels")), _scored(spark, sf_dir).persist()
    for batch in range(4):
        share = scored.filter(F.pmod(F.xxhash64("flow_start"), F.lit(4)) == batch)
        store.commit(batch, {"panels": store.stage(dashboards.panel_partials(share).coalesce(1), "panels", batch)})
    scored.unpersist()
    return dashboards.composed(store.read("panels")).select(
        "panel", "term", F.unix_seconds("bucket").alias("bucket"), *_r6("value", "second", "lat", "lon"))


AUTO_SPAN_S = 900


def _auto_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long span and a short one, each with its own length of bucket."""
    scored = _scored(spark, sf_dir).persist()
    begin = scored.agg(F.min("timestamp").alias("first")).scalar()
    short = scored.filter(F.col("timestamp") < begin + F.expr(f"interval {AUTO_SPAN_S} seconds"))
    both = [dashboards.auto_series(rows).withColumn("span", F.lit(name)) for name, rows in (("all", scored), ("short", short))]
    return both[0].unionByName(both[1]).select("span", "step", _bucket(), "attacks", "normal", "rx_bytes", "tx_bytes")


def _model_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose model is replaced by one that learned the opposite, between two of its batches."""
    base, alert = new_path(spark, "switch"), (F.col("proto") == 6) & (F.col("dscp") == 0)
    flows = _flows(spark, sf_dir).persist()
    held = versions.Models(spark, f"{base}/models")
    for number, wrong in ((1, alert), (2, ~alert)):
        held.publish(models.train(flows.withColumn("class", F.when(wrong, "1").otherwise("0")), features=SIMPLE_FEATURES, k=2))
        encode_wire(flows.filter(F.col("flow_start") % 2 == number - 1), "live").select("value").repartition(2).write.mode(
            "append").text(f"{base}/in")
        messages = detect.read_flow_stream(spark, "text", {"maxFilesPerTrigger": "1"}, f"{base}/in")
        detect.run_versioned(messages, held, "switch", geo_ranges(spark), f"{base}/store", f"{base}/state", interval=None,
                             features=SIMPLE_FEATURES).awaitTermination()
    flows.unpersist()
    return Store(spark, f"{base}/store").read("scored").groupBy("model_version", "predict").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("duration").alias("duration"))


LATENESS = "10 minutes"
#: Packets come up to this long after their time, and the stream ends with a packet this long after the others.
DELAY_US, CLOSING_US = 540_000_000, 605_000_000
STREAM_BATCHES, BATCH_FILES = 6, 3
#: Parts of the streams' state; the given tables have some 80 keys.
STREAM_PARTITIONS = 16


def _packet_stream(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """The packets as they might come: each delayed by up to nine minutes, so out of order, in batches of several files
    whose rows are shuffled. A packet of another host comes last, so that the watermark passes them all."""
    rows = _packets(spark, sf_dir)
    delay = F.pmod(F.xxhash64("num", F.lit("delay")), F.lit(DELAY_US))
    delayed = rows.withColumn("arrival", F.col("ts_us") + delay).persist()
    first, last, end = delayed.agg(F.min("arrival"), F.max("arrival"), F.max("ts_us")).head()
    step = (last - first) // STREAM_BATCHES + 1
    for part in range(STREAM_BATCHES):
        share = delayed.filter(F.call_function("div", F.col("arrival") - first, F.lit(step)) == part).drop("arrival")
        share.repartition(BATCH_FILES).write.mode("append").parquet(f"{base}/in")
    closing = rows.limit(1).withColumns({
        "num": F.lit(-1).cast("bigint"), "ts_us": F.lit(end + CLOSING_US), "srcip": F.lit("192.0.2.1"), "dstip": F.lit("192.0.2.2")})
    closing.write.mode("append").parquet(f"{base}/in")
    delayed.unpersist()
    return spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", str(BATCH_FILES)).parquet(f"{base}/in")


def _stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "meter")
    meter.run_meter(_packet_stream(spark, sf_dir, base), f"{base}/out", f"{base}/state", interval=None,
                    lateness=LATENESS, partitions=STREAM_PARTITIONS).awaitTermination()
    return _listed(features.flow_statistics(spark.read.parquet(f"{base}/out").drop("batch")))


def _stream_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "flow-meter")
    meter.run_flow_meter(_packet_stream(spark, sf_dir, base), f"{base}/out", f"{base}/state", interval=None,
                         lateness=LATENESS, partitions=STREAM_PARTITIONS).awaitTermination()
    return _listed(spark.read.parquet(f"{base}/out"))


def _stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet with whether it came too late: some of the first half come after all others."""
    base = new_path(spark, "late")
    rows = _packets(spark, sf_dir).withColumn("at", F.timestamp_micros("ts_us")).persist()
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).head()
    behind = (F.col("num") % 50 == 7) & (F.col("ts_us") < first + (last - first) // 2)
    for part in range(4):
        begin, end = (first + (last - first + 1) * p // 4 for p in (part, part + 1))
        rows.filter(~behind & (F.col("ts_us") >= begin) & (F.col("ts_us") < end)).repartition(BATCH_FILES).write.mode(
            "append").parquet(f"{base}/in")
    rows.filter(behind).repartition(BATCH_FILES).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(BATCH_FILES)).parquet(f"{base}/in")
    rows.unpersist()
    late.run_sorter(stream, "at", f"{base}/kept", f"{base}/late", f"{base}/state", LATENESS,
                    interval=None).awaitTermination()
    return spark.read.parquet(f"{base}/kept").withColumn("late", F.lit(0)).unionByName(
        spark.read.parquet(f"{base}/late").withColumn("late", F.lit(1))).select("num", "ts_us", "len", "late")


def _stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished buckets of a stream in time order; some flows of its first half come after all others, too late."""
    base = new_path(spark, "counts")
    wanted = _scored(spark, sf_dir).select("flow_start", "timestamp", "predict", "total_fpackets", "total_bpackets",
                                           "total_bvolume", "total_fvolume").persist()
    at = F.unix_micros("timestamp")
    first, last = wanted.agg(F.min(at), F.max(at)).head()
    late = (F.col("flow_start") % 50 == 7) & (at < first + (last - first) // 2)
    for part in range(4):
        begin, end = (first + (last - first + 1) * p // 4 for p in (part, part + 1))
        share = wanted.filter(~late & (at >= begin) & (at < end))
        share.coalesce(1).write.mode("append").parquet(f"{base}/in")
    wanted.filter(late).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(wanted.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/in")
    wanted.unpersist()
    query = (detect.windowed_counts(stream, lateness=LATENESS).writeStream.format("parquet").outputMode("append")
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn("bucket", F.unix_seconds("bucket"))


def queries() -> dict[str, Query]:
    d = dashboards
    q: dict[str, Query] = {
        "packets_canonical": lambda s, p: packets.canonical(_packets(s, p)).select("num", *packets.KEY, "side"),
        "packet_flags": lambda s, p: _packets(s, p).filter("proto = 6").groupBy("flags").agg(
            F.count(F.lit(1)).alias("packets")).select(
                "flags", *[packets.has_flag(F.col("flags"), n).cast("int").alias(n) for n in packets.FLAG_BITS],
                "packets"),
        "decode_frames": lambda s, p: _decoded(_frames(s, p)),
        "decode_encapsulated": _encapsulated,
        "short_frames": _short,
        "segment_packets": _segmented,
        "flows_udp": lambda s, p: _listed(features.flow_records(_packets(s, p), only=packets.UDP)),
        "flows_udp_hot": lambda s, p: _listed(features.flow_records(_packets(s, p), only=packets.UDP, hot_rows=100, chunk_span=2000)),
        "flows_all": lambda s, p: _listed(_flows(s, p)),
        "flows_hot_keys": lambda s, p: _listed(features.flow_records(_packets(s, p), hot_rows=200, chunk_span=5000)),
        "flows_clock_jump": lambda s, p: _listed(features.flow_records(
            _jumps(s, p), hot_rows=200, chunk_span=5000, head_limit=32)),
        "flows_many_keys": lambda s, p: _listed(features.flow_records(
            packets_from_events(prepare_session(s), p, many_keys=True))),
        "flows_urgent": lambda s, p: _listed(features.flow_records(_urgent(s, p))),
        "decode_unwanted": lambda s, p: _decoded(_unwanted(s, p)),
        "wire_accepted": lambda s, p: decode_wire(_damaged(s, p).drop("proto")).select(
            "flow_start", *RECORD_FIELDS),
        "wire_rejects": lambda s, p: wire_rejects(_damaged(s, p)).select("flow_start", "proto", "raw", "reason"),
        "scored_replayed": _replayed,
        "dash_stored_dst_ip": lambda s, p: d.top_terms(_stored_range(s, p), "dstip"),
        "dash_stored_threats": lambda s, p: d.threats_detected(_stored_range(s, p)),
        "offline_metrics": _offline_metrics,
        "dt_rules_agree": _rules_agree,
        "stream_score_model": _stream_model,
        "flow_valid": lambda s, p: _listed(features.emit(_flows(s, p), "valid")),
        "flow_open": lambda s, p: _listed(features.emit(_flows(s, p), "open")),
        "flow_expire_idle": _expire,
        "flow_status_counts": lambda s, p: _flows(s, p).groupBy(
            "status", F.col("is_valid").cast("int").alias("is_valid")).agg(F.count(F.lit(1)).alias("flows")),
        "flow_windowed_2s": lambda s, p: _listed(meter.meter_windows(_packets(s, p))),
        "traffic_windows_aligned": lambda s, p: _traffic(windows.aligned_windows(_headers(s, p))),
        "traffic_windows_anchored": lambda s, p: _traffic(windows.anchored_windows(_plain_headers(s, p))),
        "wire_encode": lambda s, p: encode_wire(_flows(s, p), "live", keep=["flow_start"]),
        "wire_roundtrip": lambda s, p: decode_wire(_wire(s, p)).select(*WIRE_FIELDS),
        "flows_written": _flow_files,
        "relay_lines": _relay,
        "relay_growing": _relay_growing,
        "labels_binary": lambda s, p: s.read.parquet(f"{p}/labels.parquet").select(
            "doc_id", prepare.binary_label(F.col("quality").cast("string")).alias("label")),
        "split_key": lambda s, p: _cells(prepare.split_key(_flows(s, p)), [*KEY_FIELDS, "flow_start"], F.col("features")),
        "named_features": _named,
        "reduce_features": lambda s, p: prepare.reduce_features(
            _flows(s, p), [MODEL_FIELDS.index(n) for n in ("dscp", "proto", "duration")]).select(
                *KEY_FIELDS, "dscp", "proto", "duration"),
        "drop_features": lambda s, p: prepare.drop_features(_flows(s, p).select(*RECORD_FIELDS), [0, 3]),
        "class_appended": lambda s, p: prepare.add_class(_flows(s, p)).select("flow_start", "class"),
        "to_float": lambda s, p: prepare.to_float(_flows(s, p)).select("flow_start", *MODEL_FIELDS),
        "to_text": lambda s, p: prepare.to_text(_flows(s, p)).select("flow_start", *MODEL_FIELDS),
        "labelled_points": lambda s, p: _cells(
            prepare.labelled_points(_labelled(_flows(s, p))), ["flow_start", "label"], vector_to_array("features")),
        "corr_pairs": lambda s, p: _corr(select.correlation_pairs(_flows(s, p), MODEL_FIELDS)),
        "feature_variance": lambda s, p: select.feature_variance(_flows(s, p), MODEL_FIELDS).select(
            "i", *_scaled("variance")),
        "feature_weights": lambda s, p: _weights(s, p).select(
            "idx", "name", *_scaled("weight")),
        "feature_weights_corr_sum": lambda s, p: _weights(s, p, "corr_sum").select("idx", "name", *_r6("weight")),
        "feature_topk": lambda s, p: select.top_features(_weights(s, p)).select("idx", "name"),
        "feature_clusters": lambda s, p: select.cluster_features(_flows(s, p), MODEL_FIELDS),
        "corr_pairs_lineitem": lambda s, p: _corr(select.correlation_pairs(_lines(s, p), LINE_FEATURES)),
        "feature_topk_lineitem": lambda s, p: select.top_features(
            select.feature_weights(_lines(s, p), LINE_FEATURES), 3).select(
                "idx", *_scaled("weight")),
        "geo_enrich": _geo,
        "geo_nested": _nested,
        "capture_frames": _captured,
        "scored_manifest": _manifest,
        "dash_composed": _composed,
        "dash_auto_series": _auto_series,
        "stream_model_switch": _model_switch,
        "scored_flows": lambda s, p: _document(_scored(s, p)),
        "scored_written": _stored,
        "confusion_matrix": lambda s, p: evaluate.confusion_matrix(_predictions(s, p)),
        "overall_metrics": lambda s, p: evaluate.overall_metrics(_predictions(s, p)).select(
            *_r6("accuracy", "precision", "recall", "f_measure", "test_error"), "rows"),
        "class_metrics": lambda s, p: evaluate.class_metrics(_predictions(s, p)).select(
            "label", "actual", "predicted", *_r6("precision", "recall", "false_positive_rate", "f1")),
        "weighted_metrics": lambda s, p: evaluate.weighted_metrics(_predictions(s, p)).select(*_r6(
            "weighted_precision", "weighted_recall", "weighted_f1", "weighted_false_positive_rate")),
        "test_error": lambda s, p: evaluate.overall_metrics(_predictions(s, p)).select(*_r6("test_error")),
        "dash_analyzed_flows": lambda s, p: d.analyzed_flows(_scored(s, p)),
        "dash_attack_vs_normal": lambda s, p: _series(d.attack_vs_normal(_scored(s, p))),
        "dash_destination_map": lambda s, p: _map(d.destination_map(_scored(s, p))),
        "dash_dst_ip": lambda s, p: d.top_terms(_scored(s, p), "dstip"),
        "dash_dst_port": lambda s, p: d.top_terms(_scored(s, p), "dstport"),
        "dash_packet_series": lambda s, p: _series(d.packet_series(_scored(s, p)), "avg_fpackets", "avg_bpackets"),
        "dash_packet_trend": lambda s, p: _series(d.packet_trend(_scored(s, p)), "fpackets_trend", "bpackets_trend"),
        "dash_received_bytes": lambda s, p: _map(d.received_bytes_map(_scored(s, p))),
        "dash_sources": lambda s, p: _map(d.source_map(_scored(s, p))),
        "dash_threats": lambda s, p: d.threats_detected(_scored(s, p)),
        "dash_traffic_series": lambda s, p: _series(d.traffic_series(_scored(s, p))),
        "dash_filter_attacks": lambda s, p: d.by_prediction(_scored(s, p), 1).select("flow_start", "srcip", "dstip"),
        "blocklist": lambda s, p: d.blocklist(_scored(s, p)),
        "dt_train_predict": _predict,
        "dt_describe_model": _describe,
        "dt_described_rules": _described,
        "stream_score": _stream_score,
        "stream_flows": _stream_flows,
        "stream_flows_ended": _stream_ended,
        "stream_late_rows": _stream_late,
        "stream_windowed_counts": _stream_counts,
    }
    return q
