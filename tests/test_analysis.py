import random

import pytest
from conftest import SF

from flowloom.functions.columns import ip_to_long
from flowloom.operators import dashboards, evaluate, prepare, select
from flowloom.operators.geo import locate, unusable_ranges
from flowloom.plans import model as models
from flowloom.plans.registry import queries
from flowloom.plans.scoring import document_time
from flowloom.schema import GEO_SCHEMA, MODEL_FIELDS, WIRE_FIELDS
from flowloom.sources.flows import (decode_wire, encode_wire, read_feature_dictionary, read_flows, wire_rejects,
                                    write_flows)
from flowloom.sources.sinks import read_scored, write_metrics, write_scored
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def labelled_flows(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        row = {n: r.randint(0, 1000) for n in WIRE_FIELDS}
        row |= {"srcip": f"10.0.0.{i % 250}", "dstip": "10.1.1.1", "class": "0" if row["duration"] < 500 else "dos"}
        rows.append(row)
    from flowloom.schema import WIRE_SCHEMA
    return spark.createDataFrame(rows, WIRE_SCHEMA)


def test_ranges_of_every_shape(spark):
    ranges = [(5, 5, 1.0, 1.0), (250, 260, 2.0, 2.0), (65536, 65536 * 3 - 1, 3.0, 3.0),
              (65536 * 4 + 7, 65536 * 6 + 9, 4.0, 4.0), (2**32 - 300, 2**32 - 1, 5.0, 5.0)]
    points = sorted({p for a, b, _, _ in ranges for p in (a - 1, a, a + 1, (a + b) // 2, b - 1, b, b + 1)
                     if 0 <= p < 2**32})
    table = spark.createDataFrame([(".".join(str(p >> s & 255) for s in (24, 16, 8, 0)), p) for p in points],
                                  "ip string, value bigint")
    for threshold in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        rows = locate(table, spark.createDataFrame(ranges, GEO_SCHEMA), "ip", "at").collect()
        assert len(rows) == len(points)
        for row in rows:
            want = next((lat for a, b, lat, _ in ranges if a <= row.value <= b), 48.0)
            assert row["at"].lat == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    odd = spark.createDataFrame([("1.2.3",), ("a.b.c.d",), ("1.2.3.256",), (None,)], "ip string")
    assert [r[0] for r in odd.select(ip_to_long(F.col("ip"))).collect()] == [None] * 4


def test_metrics(spark):
    pairs = [(0, 0)] * 50 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 35
    table = spark.createDataFrame(pairs, "label int, prediction int")
    overall = evaluate.overall_metrics(table).head()
    assert overall.accuracy == overall.precision == overall.recall == 0.85
    assert overall.accuracy + overall.test_error == pytest.approx(1)
    assert [tuple(r) for r in evaluate.confusion_matrix(table).collect()] == [(0.0, 50, 10), (1.0, 5, 35)]
    per = {r.label: r for r in evaluate.class_metrics(table).collect()}
    assert per[1.0].recall == 35 / 40 and per[1.0].false_positive_rate == 10 / 60
    assert per[0.0].precision == 50 / 55


def test_selection(spark):
    rows = [(float(i), float(2 * i), 7.0, float((i * 7919) % 13)) for i in range(100)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    pairs = {(r.i, r.j): r["corr"] for r in select.correlation_pairs(table, names).collect()}
    assert pairs[0, 1] == pytest.approx(1) and pairs[2, 2] == 1 and pairs[0, 2] == 0
    assert select.select_features(table, names, 2) == [1, 0]
    equal = spark.createDataFrame([(i, 1.0) for i in range(4)], "idx int, weight double")
    assert [r.idx for r in select.top_features(equal, 2).collect()] == [3, 2]


def test_wire_and_files(spark, labelled_flows, tmp_path):
    want = sorted(map(tuple, labelled_flows.collect()))
    assert sorted(map(tuple, decode_wire(encode_wire(labelled_flows)).collect())) == want
    write_flows(labelled_flows, str(tmp_path / "csv"))
    assert sorted(map(tuple, read_flows(spark, str(tmp_path / "csv")).collect())) == want
    (tmp_path / "names.csv").write_text("0,srcip,(string) The address\n4,proto,The protocol (TCP = 6, UDP = 17)\n")
    rows = read_feature_dictionary(spark, str(tmp_path / "names.csv")).orderBy("idx").collect()
    assert [r.name for r in rows] == ["srcip", "proto"] and rows[1].description.endswith("UDP = 17)")


def test_labels(spark):
    table = spark.createDataFrame([("0",), ("0.0",), ("dos",), (None,)], "class string")
    assert [r[0] for r in table.select(prepare.binary_label(F.col("class"))).collect()] == [0.0, 1.0, 1.0, None]


def test_model(spark, labelled_flows, tmp_path):
    path = str(tmp_path / "model")
    model = models.get_model(path, labelled_flows, k=41)
    again = models.get_model(path, labelled_flows.limit(0), k=41)
    assert models.selected_indices(model) == models.selected_indices(again)
    scored = models.score(again, labelled_flows)
    assert scored.columns == [*labelled_flows.columns, "predict"]
    assert scored.filter("predict = if(class = '0', 0, 1)").count() == 300
    predictions, metrics = models.evaluate(model, labelled_flows)
    assert predictions.count() == 300 and metrics.head().accuracy == 1.0
    write_metrics(metrics, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).head().accuracy == 1.0
    assert models.describe_model(spark, model).head().nodes >= 3
    cut = labelled_flows.withColumns({"class": F.when(F.col("srcport") > 500, F.col("class")),
                                      "duration": F.when(F.col("dstport") > 100, F.col("duration"))})
    good, bad = models.labelled(cut).count(), prepare.unusable_rows(cut).count()
    assert good + bad == 300 and 0 < good < 300
    with pytest.raises(Exception, match="null|NaN|null values"):
        models.score(again, cut).collect()
    rules = labelled_flows.withColumn("by_rule", models.rules_column(model))
    assert models.score(model, rules).filter("by_rule <> predict").count() == 0
    training, testing = models.keyed_split(labelled_flows, ["srcip", "duration"])
    assert training.count() + testing.count() == 300
    assert len(MODEL_FIELDS) == 41


def test_every_message_is_accepted_or_rejected(spark, labelled_flows):
    good = encode_wire(labelled_flows.limit(3)).collect()
    text = good[0][0]
    odd = ["", "x", '""', text[1:-1], text.replace(",", ",,", 1), text[:-1], '"' + text[9:], text.replace(text.split(",")[4], "1e3", 1),
           text.replace(text.split(",")[-1], '"'), '{"a": 1}', "[1]"]
    messages = spark.createDataFrame([(r[0],) for r in good] + [(o,) for o in odd] + [(None,)], "value string")
    assert decode_wire(messages).count() == 3
    rejected = wire_rejects(messages)
    assert rejected.count() == len(odd) + 1 and rejected.filter("reason is null").count() == 0


def test_the_narrowest_range_counts(spark):
    r = random.Random(11)
    ranges = [(a, min(a + r.choice([0, 3, 40, 700, 70_000, 200_000]), 400_000), float(i), 0.0)
              for i, a in enumerate(r.randrange(0, 400_000) for _ in range(150))]
    broken = [(9, 3, 1.0, 1.0), (None, 5, 1.0, 1.0), (7, 8, None, 1.0)]
    points = sorted({p for a, b, _, _ in ranges for p in (a - 1, a, b, b + 1) if 0 <= p <= 400_000})
    table = spark.createDataFrame([(".".join(str(p >> s & 255) for s in (24, 16, 8, 0)), p) for p in points],
                                  "ip string, value bigint")
    given = spark.createDataFrame(ranges + broken, GEO_SCHEMA)
    for row in locate(table, given, "ip", "at").collect():
        inside = [(b - a, -a, lat) for a, b, lat, _ in ranges if a <= row.value <= b]
        assert row["at"].lat == (min(inside)[2] if inside else 48.0)
    assert sorted(x.reason for x in unusable_ranges(given).collect()) == ["no address", "no location", "reversed"]


def test_stored_range_prunes_days(spark, tmp_path):
    table = spark.range(96).selectExpr("1.0D as predict", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) as timestamp",
                                       "'10.0.0.1' as srcip", "'10.0.0.2' as dstip", "1 as dstport", "1L as total_fpackets",
                                       "1L as total_bpackets", "named_struct('lat', 1D, 'lon', 2D) as srclocation",
                                       "named_struct('lat', 1D, 'lon', 2D) as dstlocation")
    write_scored(table, str(tmp_path / "s"), 3)
    write_scored(table.limit(2), str(tmp_path / "s"))
    part = read_scored(spark, str(tmp_path / "s"), "2024-01-02 05:00:00", "2024-01-03 00:00:00")
    assert part.count() == 19
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    panels = dashboards.composed(dashboards.panel_partials(part)).collect()
    assert {r.panel for r in panels} == set(dashboards.PANELS)
    assert [r.value for r in panels if r.panel == "threats"] == [19.0]


def test_replayed_batch_is_stored_once(spark, tmp_path):
    table = spark.sql("select 1 as predict, timestamp'2024-01-02 03:04:05' as timestamp")
    for batch in (0, 1, 1):
        write_scored(table, str(tmp_path / "s"), batch)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    later = table.selectExpr("predict", "timestamp + interval 1 day as timestamp")
    write_scored(later, str(tmp_path / "s"), 1)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_times_and_intervals(spark):
    table = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02",), ("1704164645000",)], "t string")
    got = [r[0] for r in table.select(F.unix_seconds(document_time(F.col("t")))).collect()]
    assert got == [1704164645, 1704153600, 1704164645]
    assert dashboards.auto_interval(60) == "5 seconds" and dashboards.auto_interval(86400) == "30 minutes"


def test_the_described_tree_has_two_splits_without_datagram_flows_of_dscp_zero(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")  # all datagrams of one user: a flow with replies that have a DSCP
    events.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id"))).write.parquet(
        f"{tmp_path}/events.parquet")
    rows = queries()["dt_described_rules"](spark, str(tmp_path)).collect()
    assert (17, 1) not in {(r.proto, r.no_dscp) for r in rows}
    assert {(r.nodes, r.depth, r.indices) for r in rows} == {(5, 2, "0,1")}
    assert all(r.predicted == float((r.proto, r.no_dscp) == (6, 1)) for r in rows)
