"""Flow boundaries of datagrams with built-in expressions only.

Datagrams have no connection to close, so what a packet adds to its flow follows from running maxima over the packets
before it, in arrival order:

* a packet earlier than the latest before it is dropped, and a longer gap than the timeout opens a flow;
* the latest opening is the flow, the latest gap beyond the idle limit the burst, the latest packet of a side within the
  burst the one that its gap is measured from;
* a minimum that treats zero as "not set" is the largest pair (number of the last reset, negative value).

So four layers of running values, each over values of the layer before, label all packets. A key's packets are one window;
those of a hot key are cut into stretches of arrival numbers, each layer of which takes what the earlier stretches ran up
to from a table with one row for each stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A running value: its kind (max or sum), the values, and whether a packet's own value counts for it.
Running = tuple[str, Column, bool]
_COMBINE = {"max": F.max, "sum": F.sum}


def _scan(rows: DataFrame, key: Sequence[str], columns: dict[str, Running], cut: bool, first: bool = False) -> DataFrame:
    """Adds running values in order of ``num``; with ``cut``, over the stretches (``chunk``) of each key.

    Then the rows are read twice, so all layers but the ``first`` write what they get.
    """
    place = [*key, "chunk"]
    order = Window.partitionBy(*place).orderBy("num")
    frames = {own: order.rowsBetween(Window.unboundedPreceding, 0 if own else -1) for own in (True, False)}
    running = {name: _COMBINE[kind](value).over(frames[own]) for name, (kind, value, own) in columns.items()}
    if not cut:
        return rows.withColumns(running)
    rows = rows if first else rows.checkpoint()
    earlier = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*place).agg(*[_COMBINE[kind](value).alias(f"_{name}") for name, (kind, value, _) in columns.items()])
    carried = totals.select(*place, *[_COMBINE[kind](f"_{name}").over(earlier).alias(f"_{name}")
                                      for name, (kind, _, _) in columns.items()])
    joined = rows.join(carried, place)
    return joined.withColumns({
        name: F.greatest(value, F.col(f"_{name}")) if columns[name][0] == "max" else
        F.coalesce(value, F.lit(0)) + F.coalesce(f"_{name}", F.lit(0)) for name, value in running.items()}).drop(
            *[f"_{name}" for name in columns])


def _low(reset: str, best: str) -> Column:
    """The zero-is-unset minimum so far: nothing since the last reset gives zero."""
    return F.when(F.col(f"{best}.at") == F.col(reset), -F.col(f"{best}.less")).otherwise(0).cast("bigint")


def label_datagrams(rows: DataFrame, key: Sequence[str], timeout: int, idle: int, cut: bool = False) -> DataFrame:
    """Accepted packets of ``rows`` (canonical, with ``chunk``) with the labels of ``segment``."""
    c, num = F.col, F.col("num")
    kept = rows.columns
    scanned = _scan(rows, key, {"_top": ("max", c("ts_us"), False)}, cut, first=True)
    found = scanned.filter("_top is null or ts_us >= _top").withColumn("_gap", c("ts_us") - c("_top"))
    found = found.withColumn("_opens", c("_top").isNull() | (c("_gap") > timeout))
    found = found.withColumn("_breaks", ~c("_opens") & (c("_gap") > idle))
    opening = F.when(c("_opens"), F.shiftleft(num, 1).bitwiseOR(c("side").cast("bigint")))

    def per_side(value: Column, side: int) -> Column:
        return F.when(c("side") == side, value)

    starts = F.when(c("_opens") | c("_breaks"), c("ts_us"))
    found = _scan(found, key, {
        "_flow": ("max", opening, True), "_ended": ("max", opening, False),
        "_burst": ("max", starts, True), "_last_burst": ("max", starts, False),
        "_breaks_so_far": ("sum", c("_breaks").cast("bigint"), True),
        **{f"_seen{s}": ("max", per_side(c("ts_us"), s), False) for s in (0, 1)},
        **{f"_len_reset{s}": ("max", F.when(c("_opens") | ((c("side") == s) & (c("len") == 0)), num), True) for s in (0, 1)},
    }, cut)
    seen = F.when(c("side") == 0, c("_seen0")).otherwise(c("_seen1"))
    found = found.withColumns({
        "_iat": F.when(~c("_opens") & ~c("_breaks") & (seen >= c("_burst")), c("ts_us") - seen),
        "_span": F.when(c("_breaks"), c("_top") - c("_last_burst"))})

    def best(reset: str, value: Column, counts: Column) -> Column:
        return F.when(counts & (value != 0), F.struct(c(reset).alias("at"), (-value.cast("bigint")).alias("less")))

    found = _scan(found, key, {
        "_opened_at": ("max", F.when(c("_opens"), c("_breaks_so_far")), True),
        "_span_reset": ("max", F.when(c("_opens") | (c("_span") == 0), num), True),
        **{f"_iat_reset{s}": ("max", F.when(c("_opens") | ((c("side") == s) & (c("_iat") == 0)), num), True) for s in (0, 1)},
        **{f"_len{s}": ("max", best(f"_len_reset{s}", c("len"), c("side") == s), True) for s in (0, 1)},
    }, cut)
    found = _scan(found, key, {
        "_low_span": ("max", best("_span_reset", c("_span"), c("_span").isNotNull()), True),
        **{f"_iat{s}": ("max", best(f"_iat_reset{s}", c("_iat"), (c("side") == s) & c("_iat").isNotNull()), True) for s in (0, 1)},
    }, cut)
    side = c("side")
    none = {"bigint": F.lit(None).cast("bigint"), "boolean": F.lit(None).cast("boolean")}

    def mine(name: str) -> Column:
        return F.when(side == 0, _low(f"_{name}_reset0", f"_{name}0")).otherwise(_low(f"_{name}_reset1", f"_{name}1"))

    no = F.lit(False)
    added = {"flow_start": F.shiftright("_flow", 1), "front": c("_flow").bitwiseAND(F.lit(1)).cast("tinyint"),
             "gap": F.when(~c("_opens"), c("_gap")), "iat": c("_iat"), "span": c("_span"), "burst": c("_burst"),
             "client_ready": no, "closes": no, "expires": no, "low_iat": mine("iat"), "low_span": _low("_span_reset", "_low_span"),
             "low_len": mine("len"), "burst_no": c("_breaks_so_far") - c("_opened_at")}
    # a flow that a gap ended: a row that carries no packet
    ended = {name: none["boolean"] if name in ("client_ready", "closes") else none["bigint"] for name in added} | {
        "flow_start": F.shiftright("_ended", 1), "front": c("_ended").bitwiseAND(F.lit(1)).cast("tinyint"), "expires": F.lit(True)}
    one, two = (F.struct(*[value.alias(name) for name, value in label.items()]) for label in (added, ended))
    labels = F.when(c("_opens") & c("_ended").isNotNull(), F.array(two, one)).otherwise(F.array(one))
    return found.select(*kept, F.explode(labels).alias("_label")).select(*kept, "_label.*")
