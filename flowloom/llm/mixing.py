"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Among all rates between 0 and ``limit`` that give each
source its target of tokens, those closest in relative entropy to one copy each are exponentially tilted in the
document's size: rate / (limit - rate) = exp(lambda * size) / (limit - 1), with one multiplier per source. The dual is
convex; Newton steps find the multipliers. Documents of one source and one size share a rate, so each step aggregates a
table of (source, size, count), however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import word_count

LIMIT = 3
STEPS = 60
CLOSE = 1e-9
SALTS = 256


def source_targets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Target of each source from ``sizes`` (source, size, n): sid, source, source_size, target.

    Sources by code point, NULL last, weigh 1, 2, 3 and so on again. They share the total by weight; where a share
    exceeds ``limit`` times the source's size it stops there and the excess goes to the others by weight. One row per
    source enters the windows.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("sid", F.row_number().over(everything)).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    by_room = Window.orderBy((F.col("source_size") * limit / F.col("weight")), "sid")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    room = F.col("source_size") * limit / F.col("weight")
    share = (F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(
            F.sum(F.col("source_size") * limit).over(before), F.lit(0))) / F.sum("weight").over(after)
    shared = totals.select("*", room.alias("room"), share.alias("share"))
    level = F.min(F.when(F.col("share") <= F.col("room"), F.struct("room", "sid", "share"))).over(
        Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return shared.withColumn("level", level["share"]).select(
        "sid", "source", "source_size", F.least(
            (F.col("source_size") * limit).cast("double"),
            F.coalesce(F.col("level") * F.col("weight"), (F.col("source_size") * limit).cast("double"))).alias("target"))


def _rate(tilt: Column, limit: int) -> Column:
    return F.lit(float(limit)) / (1 + F.lit(float(limit - 1)) * F.exp(-tilt))


def _total(value: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def multipliers(sizes: DataFrame, targets: DataFrame, limit: int = LIMIT, steps: int = STEPS) -> DataFrame:
    """The multiplier of each source (sid, scale, tilt): rate = f(tilt * size / scale).

    Newton steps on the dual, kept inside a bracket that every step narrows. A source whose target is all that
    ``limit`` copies of its documents hold has no finite multiplier and gets NULL.
    """
    scale = sizes.groupBy("sid").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = targets.where("source_size > 0").select(
        "sid", (F.col("target") / F.col("source_size")).alias("goal"), "source_size").join(scale, "sid").where(
            F.col("goal") < limit * (1 - CLOSE)).select(
                "*", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"),
                F.lit(None).cast("double").alias("high")).checkpoint()
    x = F.col("size") / F.col("scale")
    for _ in range(steps):
        rate = _rate(F.col("tilt") * x, limit)
        slope = F.col("n") * x * x * rate * (1 - rate / limit)
        now = sizes.join(state.select("sid", "scale", "tilt"), "sid").groupBy("sid").agg(
            _total(F.col("n") * x * rate).alias("value"), _total(slope).alias("slope"), _total(F.col("n") * x).alias("all"))
        moved = state.join(now, "sid").withColumn("gap", F.col("value") / F.col("all") - F.col("goal"))
        low = F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("gap") >= 0, F.col("tilt")).otherwise(F.col("high"))
        moved = moved.withColumns({"low": low, "high": high})
        step = F.col("tilt") - F.col("gap") * F.col("all") / F.col("slope")
        inside = ((F.col("slope") > 0) & (F.col("low").isNull() | (step > F.col("low")))
                  & (F.col("high").isNull() | (step < F.col("high")))
                  & (F.abs(step - F.col("tilt")) <= 2 + 4 * F.abs("tilt")))
        safe = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(
            F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.abs("gap") <= CLOSE
        moved = moved.withColumn("next", F.when(done, F.col("tilt")).when(inside, step).otherwise(safe))
        moved = moved.select("sid", "goal", "source_size", "scale", F.col("next").alias("tilt"), "low", "high", (
            ~done & (F.col("next") != F.col("tilt"))).alias("open")).checkpoint()
        state = moved.drop("open")
        if not moved.where("open").limit(1).count():
            break
    return state.select("sid", "scale", "tilt")


def _bin(size: Column) -> Column:
    """Sizes that agree in their leading six bits, so differ by 3 % at most; below 64 each size is its own."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size.cast("double"))) - 5, F.lit(0)))
    return (F.floor(size / step) * step).cast("long")


def group_copies(sizes: DataFrame, targets: DataFrame, tilts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """How many copies the documents of each (sid, size) get together: sid, size, n, copies.

    Sizes are taken in bins, from the largest down. Each bin takes as many copies as bring its source's tokens nearest
    to the running total of the rates, so what rounding leaves over shrinks with the sizes. A source's array has one
    element for each bin: at most 32 for each doubling of the size.
    """
    rate = F.coalesce(_rate(F.col("tilt") * F.col("size") / F.col("scale"), limit), F.lit(float(limit)))
    rated = sizes.where("size > 0").join(tilts, "sid", "left").select(
        "sid", _bin(F.col("size")).alias("bin"), "size", "n", (F.col("n") * F.col("size") * rate).alias("due"))
    bins = rated.groupBy("sid", "bin").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("tokens"), _total(F.col("due")).alias("due"))
    lists = bins.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "tokens", "due")), False).alias("bins"))

    def take(state: Column, item: Column) -> Column:
        mean, due = item["tokens"] / item["n"], state["due"] + item["due"]
        copies = F.greatest(F.lit(0).cast("long"), F.least(
            item["n"] * limit, F.floor((due - state["taken"]) / mean + 0.5)))
        return F.struct(due.alias("due"), (state["taken"] + copies * mean).alias("taken"),
                        F.concat(state["copies"], F.array(copies)).alias("copies"))

    start = F.expr("named_struct('due', 0D, 'taken', 0D, 'copies', cast(array() as array<bigint>))")
    taken = lists.select("sid", F.explode(F.arrays_zip("bins", F.aggregate(
        "bins", start, take, lambda s: s["copies"]).alias("copies"))).alias("e")).select(
            "sid", F.col("e.bins.bin").alias("bin"), F.col("e.bins.n").alias("bin_n"),
            F.col("e.copies").alias("bin_copies"))
    upto = F.sum("n").over(Window.partitionBy("sid", "bin").orderBy(F.desc("size")))
    within = rated.select("sid", "bin", "size", "n", upto.alias("upto")).join(taken, ["sid", "bin"])

    def dealt(edge: str) -> str:
        return f"cast((2 * cast({edge} as decimal(20)) * cast(bin_copies as decimal(10)) + bin_n) div (2 * bin_n) as bigint)"

    return within.select("sid", "size", "n", F.expr(f"{dealt('upto')} - {dealt('upto - n')}").alias("copies"))


def deal_copies(documents: DataFrame, copies: DataFrame) -> DataFrame:
    """Copies of each document, ``documents`` (doc_id, sid, size): adds ``copies``.

    Of the n documents of one source and size, all get copies div n, and the first (copies mod n) by a hash of doc_id
    one more. Positions are counted within ``SALTS`` parts of a group and shifted by the parts before.
    """
    parted = documents.withColumns({"order": F.xxhash64("doc_id", F.lit("mix"))}).withColumn(
        "part", F.pmod(F.col("order"), F.lit(SALTS)))
    uneven = copies.withColumns({"each": F.expr("copies div greatest(n, 1)"),
                                 "more": F.expr("copies % greatest(n, 1)")}).select("sid", "size", "each", "more")
    counts = parted.groupBy("sid", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid", "size").orderBy("part")) - F.col("n")
    counts = counts.select("sid", "size", "part", before.alias("before")).join(uneven, ["sid", "size"], "left")
    place = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("order", "doc_id"))
    placed = parted.withColumn("place", place).join(counts, ["sid", "size", "part"], "left")
    extra = F.when(F.col("before") + F.col("place") <= F.col("more"), 1).otherwise(0)
    return placed.select("doc_id", "sid", "size", F.coalesce(F.col("each") + extra, F.lit(0)).cast("long").alias("copies"))


def mix(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The mix of ``documents`` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words, ``taken`` is size times copies. Documents without words get no copies. Rows that
    are repeated count once each. An empty table gives no rows. Results don't depend on how rows are partitioned.
    """
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size")).checkpoint()
    sizes = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes, limit).checkpoint()
    named = targets.select("sid", F.col("source").alias("_source"))
    sizes = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("sid", "size", "n").checkpoint()
    copies = group_copies(sizes, targets, multipliers(sizes, targets, limit), limit)
    keyed = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "sid", "size")
    dealt = deal_copies(keyed, copies)
    return dealt.join(targets, "sid").select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def expand(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it has copies; columns of ``documents``."""
    times = mixed.where("copies > 0").select(F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"),
                                             F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    # rows that share id, source and size may differ in copies: each copy count goes to one of them
    place = Window.partitionBy("doc_id", "source", "_words").orderBy("_hash")
    other = Window.partitionBy("_doc_id", "_source", "_size").orderBy(F.desc("_copies"))
    rows = documents.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("_words"),
                            F.xxhash64("text").alias("_hash")).withColumn("_place", F.row_number().over(place))
    times = times.withColumn("_number", F.row_number().over(other))
    joined = rows.join(times, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
                       & (F.col("_words") == F.col("_size")) & (F.col("_place") == F.col("_number")))
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")
