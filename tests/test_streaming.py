import io
import json
import random
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.waiting import due_ms, released
from flowloom.operators.dashboards import blocklist, composed
from flowloom.operators.features import flow_records, flow_statistics
from flowloom.operators.packets import KEY, canonical
from flowloom.operators.segment import symbol
from flowloom.plans import registry
from flowloom.plans.registry import queries
from flowloom.plans.scoring import rule_predict
from flowloom.schema import PACKET_SCHEMA
from flowloom.sources.commits import Store
from flowloom.sources.fixtures import geo_ranges, packets_from_events
from flowloom.sources.flows import encode_wire, write_flows
from flowloom.sources.growing import lines_between, read_growing, whole_lines_end
from flowloom.streaming import meter, ordered
from flowloom.streaming.detect import read_flow_stream, relay_lines, run_committed
from flowloom.streaming.late import run_sorter
from flowloom.streaming.meter import meter_batches, run_flow_meter, run_meter
from helpers import ACK, FINACK, frame_of, handshake, tcp, udp


def test_streamed_flows_equal_batch(spark):
    """But for the status: the stream's watermark also ends flows that no later packet ends."""
    q = queries()
    streamed, batch = q["stream_flows"](spark, SF), q["flows_all"](spark, SF)
    assert sorted(streamed.drop("status").collect()) == sorted(batch.drop("status").collect())
    ended = {r.status for r in streamed.join(batch.filter("status = 'closed'"), "flow_start", "left_semi").collect()}
    assert "closed" in ended


def test_scoring_with_a_model_meters_once(spark, monkeypatch):
    metered, inner = [], registry._flows
    monkeypatch.setattr(registry, "_flows", lambda *a: metered.append(1) or inner(*a))
    assert queries()["stream_score_model"](spark, SF).count() == 2
    assert len(metered) == 1


OTHER = (("10.9.9.9", 1), ("10.9.9.8", 2))


def streamed(spark, tmp_path, parts):
    for part in parts:
        frame_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))


def test_silent_keys_leave_the_state(spark, tmp_path):
    stream = streamed(spark, tmp_path, [
        [udp(1, 1_000_000)], [udp(2, 2_000_000_000, ends=OTHER)], [udp(3, 4_000_000_000, ends=OTHER)], [udp(4, 4_100_000_000)]])
    run_meter(stream, str(tmp_path / "out"), str(tmp_path / "state"), interval=None, lateness="1 second").awaitTermination()
    rows = flow_statistics(spark.read.parquet(str(tmp_path / "out")).drop("batch")).orderBy("flow_start").collect()
    assert [(r.srcip, r.status) for r in rows] == [
        ("10.0.0.1", "timed_out"), ("10.9.9.9", "timed_out"), ("10.9.9.9", "open")]


def test_packets_are_taken_by_number_and_late_ones_are_kept_apart(spark, tmp_path):
    """A handshake in four batches that come backwards; a reply of the same key comes after the watermark has passed."""
    shake = handshake(at=50_000_000) + [tcp(5, 50_000_050, "s", FINACK), tcp(6, 50_000_060, "c", FINACK), tcp(7, 50_000_070, "s", ACK)]
    parts = [[p] for p in reversed(shake)] + [[udp(20, 200_000_000, ends=OTHER)], [tcp(8, 50_000_080, "s", ACK)],
                                              [udp(21, 201_000_000, ends=OTHER)]]
    for name, run in (("packets", run_meter), ("flows", run_flow_meter)):
        stream = streamed(spark, tmp_path / name, parts)
        run(stream, str(tmp_path / name / "out"), str(tmp_path / name / "state"), interval=None, lateness="1 minute",
            rejects=str(tmp_path / name / "late")).awaitTermination()
        late = spark.read.parquet(str(tmp_path / name / "late")).collect()
        assert [json.loads(r.packet)["num"] for r in late] == [8]
    rows = spark.read.parquet(str(tmp_path / "packets" / "out")).where("not expires").orderBy("num").collect()
    assert [r.num for r in rows] == [p[0] for p in shake]
    want = flow_records(frame_of(spark, shake)).collect()
    assert spark.read.parquet(str(tmp_path / "flows" / "out")).drop("batch").select(*want[0].asDict()).collect() == want
    assert want[0].status == "closed" and want[0].is_valid


def test_waiting_slices_give_the_order_of_numbers():
    rng = random.Random(5)
    packets = [{"num": n, "ts_us": 1000 * n + rng.randrange(-2000, 2000)} for n in range(300)]
    width = skew = 5000
    slices = {}
    for p in rng.sample(packets, len(packets)):
        slices.setdefault(p["ts_us"] // width, []).append(p)
    out, mark, left = [], 100, {}
    for mark in (100, 101, 180, 320):
        ready = {n for n in slices if due_ms(n, width, skew) <= mark}
        for taken, left in released(list(slices), ready, slices.pop, width):
            out += taken
            assert sum(map(len, left.values())) <= 12
        slices.update({n: p for n, p in left.items() if p})
        left = {}
    assert [p["num"] for p in out] == list(range(300))


class Held(dict):
    """A value or a map of a stream's state, and the timers that are set."""

    def __init__(self):
        super().__init__()
        self.timers = []
        self.removeKey, self.updateValue, self.getValue = self.pop, self.__setitem__, self.__getitem__
        self.registerTimer, self.update = self.timers.append, lambda row: self.__setitem__("row", row)

    def exists(self):
        return "row" in self

    def get(self):
        return self["row"]


def test_a_key_with_many_slices_has_few_entries_and_one_timer(spark):
    from types import SimpleNamespace

    packets = canonical(frame_of(spark, [tcp(i, i * 3_000_000, "cs"[i % 2], ACK, 40 + i % 9) for i in range(500)])).withColumn(
        "symbol", symbol()).drop("srcip", "srcport", "dstip", "dstport").withColumn("chunk", F.lit(0).cast("bigint"))
    out = meter._labelled_schema(packets.schema.fields)
    kind = ordered.Segmenter(KEY, packets.schema, T.StructType([T.StructField(f.name, f.dataType) for f in out]),
                             600_000_000, 1_000_000, 2_000_000, 2_000_000)
    held, chunks, at = Held(), Held(), lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    kind.init(SimpleNamespace(getValueState=lambda *_: held, getMapState=lambda *_: chunks, registerTimer=held.registerTimer))
    rows = packets.toPandas()
    key = tuple(rows[KEY].iloc[0])
    assert list(kind.handleInputRows(key, iter([rows[250:], rows[:250]]), at(0))) == []
    assert len(chunks) == 2 and len(held.timers) == 1
    made = [*kind.handleExpiredTimer(key, at(700_000), None), *kind.handleExpiredTimer(key, at(1_500_000), None)]
    assert [len(m) for m in made] == [232, 267] and [n for m in made for n in m["num"]] == list(range(499))
    assert len(chunks) == 1 and len(held.timers) <= 5


def test_rows_without_a_time_and_odd_names(spark, tmp_path):
    rows = [(1, 5, "a"), (2, 100, "b"), (3, None, "c"), (4, 300, "d"), (5, 10, "e")]
    for part in ([0, 1, 2], [3], [4]):
        spark.createDataFrame([rows[i] for i in part], "`part` long, `_at` long, `odd name` string").withColumn(
            "time", F.timestamp_seconds("_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    run_sorter(stream, "time", str(tmp_path / "kept"), str(tmp_path / "late"), str(tmp_path / "state"), "1 minute",
               interval=None).awaitTermination()
    kept, late = (spark.read.parquet(str(tmp_path / n)).drop("batch") for n in ("kept", "late"))
    assert kept.columns == schema.names
    assert sorted(r[0] for r in kept.collect()) == [1, 2, 3, 4] and [r[0] for r in late.collect()] == [5]


def test_rows_are_late_after_a_restart_too(spark, tmp_path):
    """The second run knows the latest time of the first; rows without a time are not late."""
    folders = [str(tmp_path / n) for n in ("kept", "late", "state")]
    for number, rows in enumerate(([(1, 1000, 1), (2, None, 2)], [(3, 2000, 3), (4, 939, 4), (5, 940, 5)], [(6, 1939, 6), (7, None, 7)])):
        spark.createDataFrame(rows, "id int, _at long, of int").select("id", F.timestamp_seconds("_at").alias("time"), "of").coalesce(
            1).write.parquet(str(tmp_path / f"in/{number}"))
        stream = spark.readStream.schema("id int, time timestamp, of int").parquet(str(tmp_path / "in/*"))
        query = run_sorter(stream, "time", *folders, "1 minute", interval=None)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"] == []
    kept, late = (spark.read.parquet(n) for n in folders[:2])
    assert {r.id for r in kept.collect()} == {1, 2, 3, 5, 7} and {r.id for r in late.collect()} == {4, 6}


def test_each_batch_is_a_capture(spark, tmp_path):
    packets = packets_from_events(spark, SF)
    packets.filter("num < 4000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    packets.filter("num >= 4000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    meter_batches(stream, lambda flows, batch: write_flows(flows, str(tmp_path / f"out/{batch}")),
                  str(tmp_path / "state"), interval=None).awaitTermination()
    want = sum(flow_records(packets.filter(f), policy="open").count() for f in ("num < 4000", "num >= 4000"))
    assert spark.read.csv(str(tmp_path / "out/*")).count() == want


def test_growing_files_are_read_once_by_whole_lines(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def run():
        stream = read_growing(spark, str(folder), partBytes="7")
        stream.writeStream.format("text").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(
            availableNow=True).start().awaitTermination()
        return sorted(r.value for r in spark.read.text(str(out)).collect())

    first, second = folder / "a.log", folder / "b.log"
    first.write_bytes(b"one\ntwo\r\n\nthree and a ha")
    assert run() == ["", "one", "two"]
    assert run() == ["", "one", "two"]
    with first.open("ab") as file:
        file.write(b"lf\nfour")
    second.write_bytes("é\nfive\n".encode())
    (folder / "_hidden").write_bytes(b"no\n")
    assert run() == sorted(["", "one", "two", "three and a half", "é", "five"])
    second.write_bytes(b"new\n")  # shorter than before: another file
    assert run() == sorted(["", "one", "two", "three and a half", "é", "five", "new"])


def test_stretches_of_a_file_share_its_lines():
    data = b"".join(bytes([97 + i % 26]) * (i * 7 % 23) + b"\n" for i in range(200))
    for length in (1, 5, 64, 1000):
        found = [line for a in range(0, len(data), length)
                 for line in lines_between(io.BytesIO(data), a, min(a + length, len(data)), len(data))]
        assert found == data.split(b"\n")[:-1]
    assert whole_lines_end(io.BytesIO(b"ab\ncd"), 5, 0) == 3 and whole_lines_end(io.BytesIO(b"abcd"), 4, 2) == 2


def until(condition, seconds=60):
    end = time.monotonic() + seconds
    while not condition() and time.monotonic() < end:
        time.sleep(0.5)
    assert condition()


def test_a_running_relay_follows_its_files(spark, tmp_path):
    """A trigger every second; lines are appended while the stream runs."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.log").write_text("1\n2\nhal")

    def seen():
        return sorted(r.value for r in spark.read.text(str(out)).collect()) if list(out.glob("part-*")) else []

    query = relay_lines(spark, str(folder), str(out), str(tmp_path / "state"), interval="1 second", growing=True)
    try:
        until(lambda: seen() == ["1", "2"])
        with (folder / "a.log").open("a") as file:
            file.write("f\n3\n")
        (folder / "b.log").write_text("4\n")
        until(lambda: seen() == ["1", "2", "3", "4", "half"])
    finally:
        query.stop()


def test_committed_detection_survives_a_restart(spark, tmp_path):
    """A batch that failed before its commit is scored again and seen once; a finished one is not scored again."""
    messages = encode_wire(queries()["flows_all"](spark, SF), "live").select("value")
    messages.repartition(3).write.text(str(tmp_path / "in"))
    stream = read_flow_stream(spark, "text", {"maxFilesPerTrigger": "1"}, str(tmp_path / "in"))
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000))

    def run(ranges):
        run_committed(stream, rule_predict(), ranges, str(tmp_path / "store"), str(tmp_path / "state"), interval=None,
                      at=at).awaitTermination()

    with pytest.raises(Exception, match="ip_from"):
        run(geo_ranges(spark).drop("ip_from"))
    run(geo_ranges(spark))
    run(geo_ranges(spark))
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("scored").count() == messages.count() and not store.committed(3)
    panels = {r.panel: r.value for r in composed(store.read("panels")).where("panel = 'threats'").collect()}
    assert panels["threats"] == store.read("scored").agg(F.sum("predict")).head()[0]
    assert store.read("blocked").distinct().count() == blocklist(store.read("scored")).count()
