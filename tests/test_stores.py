"""Commits over several sinks, model versions, capture files, the stored overview."""

import threading

import pytest
from conftest import SF
from flowloom.operators import dashboards
from flowloom.plans import model as models
from flowloom.plans.registry import SIMPLE_FEATURES, queries
from flowloom.plans.versions import Models
from flowloom.schema import FRAME_SCHEMA
from flowloom.sources.captures import read_captures
from flowloom.sources.commits import Files, Store
from flowloom.sources.pcapfiles import write_captures
from pyspark.sql import functions as F


def numbers(spark, *values):
    return spark.createDataFrame([(v, v % 2) for v in values], "n int, odd int")


def shown(store, sink="rows"):
    return sorted(r.n for r in store.read(sink).collect())


def test_only_one_publishes(spark, tmp_path):
    files, won = Files(spark, str(tmp_path)), []
    racers = [threading.Thread(target=lambda i=i: won.append((files.publish("x/1.json", str(i)), i))) for i in range(6)]
    for racer in racers:
        racer.start()
    for racer in racers:
        racer.join()
    assert sum(w for w, _ in won) == 1
    assert files.read("x/1.json") == str(next(i for w, i in won if w)) and files.names("x") == ["1.json"]


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.read("rows")
    for batch in (0, 1):
        assert store.commit(batch, {"rows": store.stage(numbers(spark, batch * 10, batch * 10 + 1), "rows", batch, ["odd"]),
                                    "other": store.stage(numbers(spark, batch), "other", batch)})
    store.stage(numbers(spark, 20, 21), "rows", 2, ["odd"])  # killed before its other sinks
    assert shown(store) == [0, 1, 10, 11] and shown(store, "other") == [0, 1] and not store.committed(2)
    late = store.stage(numbers(spark, 77), "rows", 1, ["odd"])
    assert not store.commit(1, {"rows": late}) and shown(store) == [0, 1, 10, 11]
    assert store.commit(2, {"rows": store.stage(numbers(spark, 20, 21), "rows", 2, ["odd"])})
    assert shown(store) == [0, 1, 10, 11, 20, 21] and store.read("rows").columns == ["n", "odd"]


def test_compaction_keeps_what_is_there(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for batch in range(5):
        store.commit(batch, {"rows": store.stage(numbers(spark, batch * 2, batch * 2 + 1), "rows", batch, ["odd"])})
    for upto, folders in ((1, 4), (3, 2), (3, 2), (9, 1)):
        store.compact(upto, {"rows": ["odd"]}, {"rows": ["odd", "n"]}, files=2)
        assert shown(store) == list(range(10)) and len(store.visible()[0]["rows"]) == folders
        assert store.committed(min(upto, 4)) and not store.committed(5)
    store.commit(5, {"rows": store.stage(numbers(spark, 10), "rows", 5, ["odd"])})
    assert shown(store) == list(range(11))


def test_versions_and_the_first_to_train(spark, tmp_path):
    flows = queries()["stream_flows_ended"](spark, SF).where("true")
    alert = (F.col("proto") == 6) & (F.col("dscp") == 0)
    fitted = [models.train(flows.withColumn("class", F.when(a, "1").otherwise("0")), features=SIMPLE_FEATURES, k=2)
              for a in (alert, ~alert)]
    held = Models(spark, str(tmp_path / "m"))
    assert held.publish(fitted[0], first=True) == 1
    assert Models(spark, str(tmp_path / "m")).publish(fitted[1], first=True) == 1  # the other job came first
    number, model = held.train_or_load(flows)
    assert number == 1 and models.tree_of(model).toDebugString.split("\n", 1)[1] == models.tree_of(fitted[0]).toDebugString.split("\n", 1)[1]
    assert held.of_batch("run", 0) == 1
    assert held.publish(fitted[1]) == 2 and held.current() == 2
    assert held.of_batch("run", 0) == 1 and held.of_batch("run", 1) == 2 and held.of_batch("other", 0) == 2


def test_written_captures_are_read_back(spark, tmp_path):
    rows = [(i, i / 7, bytes([i % 256]) * (i % 90 + 1)) for i in range(1, 400)]
    frames = spark.createDataFrame(rows, FRAME_SCHEMA).repartitionByRange(3, "num").sortWithinPartitions("num")
    write_captures(frames, str(tmp_path / "c"))
    write_captures(frames.limit(0), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").iterdir())) == 3
    found = read_captures(spark, str(tmp_path / "c"), span=2000).collect()
    assert sorted((round(r.ts * 1e6), bytes(r.frame)) for r in found) == sorted((round(t * 1e6), f) for _, t, f in rows)
    assert all(n == sorted(n) == list(range(1, len(n) + 1)) for n in (
        sorted(r.num for r in found if r.capture == c) for c in {r.capture for r in found}))
    write_captures(frames.limit(5), str(tmp_path / "c"), mode="overwrite")
    assert read_captures(spark, str(tmp_path / "c")).count() == 5


def test_the_overview_reads_its_parts_once(spark, tmp_path):
    """Parts in any cut give the same panels; one scan of the stored table."""
    table = spark.range(500).select(
        F.timestamp_seconds(F.col("id") * 60).alias("timestamp"), (F.col("id") % 3 == 0).cast("double").alias("predict"),
        F.concat(F.lit("10.0.0."), F.col("id") % 23).alias("dstip"), (F.col("id") % 17 * 5).cast("int").alias("dstport"),
        F.col("id").alias("total_fpackets"), (F.col("id") * 2).alias("total_bpackets"),
        *[F.struct((F.col("id") % 50 - by).cast("double").alias("lat"), F.lit(by).cast("double").alias("lon")).alias(n)
          for n, by in (("srclocation", 20), ("dstlocation", 10))])
    store = Store(spark, str(tmp_path))
    for batch in range(3):
        store.commit(batch, {"panels": store.stage(dashboards.panel_partials(table.where(F.col("total_fpackets") % 3 == batch)), "panels", batch)})
    whole = dashboards.composed(dashboards.panel_partials(table))
    parts = dashboards.composed(store.read("panels"))
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    ports = [(r.term, r.value) for r in parts.where("panel = 'dst_port'").collect()]
    want = [(str(r.dstport), float(r.flows)) for r in dashboards.top_terms(table, "dstport").collect()]
    assert sorted(ports) == sorted(want)


def test_the_bucket_follows_the_span(spark):
    def series(seconds):
        table = spark.range(20).select(F.timestamp_seconds(F.col("id") * seconds / 19).alias("timestamp"), F.lit(1.0).alias("predict"),
                                       F.lit(3).alias("total_bvolume"), F.lit(4).alias("total_fvolume"))
        return dashboards.auto_series(table).collect()

    for seconds in (0, 49, 51, 3000, 86_400, 10_000_000, 500_000_000):
        rows = series(seconds)
        names = dict(zip(dashboards.LADDER, dashboards._SECONDS, strict=True))
        assert {r.step for r in rows} == {names[dashboards.auto_interval(seconds)]}
        assert sum(r.attacks for r in rows) == 20 and len(rows) <= 52 or seconds > 100_000_000


def test_one_capture_in_several_files_has_one_count(spark, tmp_path):
    frames = spark.range(3000).selectExpr("id * 1.0D as ts", "cast(repeat('x', 20 + id % 50) as binary) as frame")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_captures(frames.repartitionByRange("ts").sortWithinPartitions("ts"), f"{tmp_path}/one")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(list((tmp_path / "one").glob("*.pcap"))) > 1
    found = read_captures(spark, f"{tmp_path}/one/*.pcap", span=4096, rotated=True)
    assert {(r.num, r.ts) for r in found.collect()} == {(i + 1, float(i)) for i in range(3000)}
