"""Traffic characteristics per time window and address pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions import folds
from flowloom.functions.scans import running_max
from flowloom.operators.packets import FLAG_BITS, ICMP, TCP, UDP
from flowloom.session import shared_folder

register_pickle_by_value(folds)

WINDOW_US = 2_000_000
SCAN_SPAN = 4_000_000
BLOCK_WINDOWS = 256


def aligned_windows(packets: DataFrame, width_us: int = WINDOW_US) -> DataFrame:
    """Add ``window_start``: windows on a fixed grid, no exchange needed."""
    return packets.withColumn("window_start", F.col("ts_us") - F.col("ts_us") % width_us)


def anchored_windows(packets: DataFrame, within: Sequence[str] = (), width_us: int = WINDOW_US,
                     scan_span: int = SCAN_SPAN, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Add ``window_start``: a window opens with a packet, and the first later packet beyond its width closes
    it and opens the next.  Starts anew for each value of ``within`` (a capture).

    A packet can only open a window if it is later than all packets before it.  Such packets are cut into blocks
    of ``block_windows`` widths of time.  Each block, on its own, follows the chain from every packet that may be
    its first start (those within one width of its beginning) to its last start. Each such start so leads to one in a
    later block; ``_on_the_way`` finds those that the first packet leads to, which give each block its true first start.
    From there its starts are found, again block by block.
    """
    shared_folder(packets.sparkSession)
    rows = packets.withColumn("_all", F.lit(0)) if not within else packets
    group = list(within) or ["_all"]
    before = running_max(rows.select(*group, "num", "ts_us"), group, "num", "ts_us", "_before", scan_span,
                         inclusive=False)
    later = (before.filter(F.col("_before").isNull() | (F.col("ts_us") > F.col("_before")))
             .select(*group, F.call_function("div", F.col("ts_us"), F.lit(width_us * block_windows)).alias("_block"),
                     "ts_us", "num").checkpoint())
    place = [*group, "_block"]
    maps = T.StructType([*[later.schema[c] for c in place], T.StructField("first", T.LongType()),
                         T.StructField("last", T.LongType())])
    followed = (later.repartition(*place).sortWithinPartitions(*place, "ts_us")
                .mapInArrow(folds.block_starts(width_us, place), maps))
    entered = _on_the_way(followed, group, width_us, width_us * block_windows).withColumnRenamed("first", "_first")
    chain = later.join(entered, place).filter("ts_us >= _first").drop("_first")
    starts = (chain.repartition(*place).sortWithinPartitions(*place, "ts_us")
              .mapInArrow(folds.anchor_starts(width_us, place), chain.schema)
              .select(*group, "num", F.col("ts_us").alias("_start"), F.lit(False).alias("_packet")))
    merged = rows.withColumn("_packet", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    placed = running_max(merged, group, "num", "_start", "window_start", scan_span, tie=F.col("_packet"))
    return placed.filter("_packet").select(*packets.columns, "window_start")


def _on_the_way(maps: DataFrame, group: Sequence[str], width_us: int, block_us: int) -> DataFrame:
    """The first starts that the group's very first packet leads to: group, _block, first.

    ``maps`` (group, _block, first, last) says where a first start ends up in its block; the next start is the first one
    mapped that is more than a width later. Ways are doubled: after k rounds each start knows the one 2^k steps on, and
    the starts found are those up to 2^k steps from the first. All joins are on the start, none on the group alone, and
    there are as many rounds as the number of blocks has binary digits.
    """
    # the first mapped start after each way out: within the block the way leads into, or the first of a later block
    out = F.col("last") + width_us
    ends = maps.select(*group, F.call_function("div", out, F.lit(block_us)).alias("_block"), out.alias("at"),
                       F.col("first").alias("start"), F.lit(1).alias("probe"))
    marks = maps.select(*group, "_block", F.col("first").alias("at"), F.lit(None).cast("long").alias("start"), F.lit(0).alias("probe"))
    place = [*group, "_block"]
    after = Window.partitionBy(*place).orderBy("at", "probe").rowsBetween(1, Window.unboundedFollowing)
    near = marks.unionByName(ends).withColumn("_near", F.min(F.when(F.col("probe") == 0, F.col("at"))).over(after)).where("probe = 1")
    # one row for each block, also for those that ways lead into without a start of their own
    blocks = maps.groupBy(*place).agg(F.min("first").alias("begin")).unionByName(
        ends.select(*place).distinct().withColumn("begin", F.lit(None).cast("long"))).groupBy(*place).agg(F.min("begin").alias("begin"))
    later = Window.partitionBy(*group).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    carried = blocks.select(*place, F.min("begin").over(later).alias("_far"))
    steps = near.join(carried, place).select(*group, "start", F.coalesce("_near", "_far").alias("next")).where(
        "next is not null").checkpoint()
    known = maps.groupBy(*group).agg(F.min("first").alias("start")).checkpoint()
    while True:
        further = known.join(steps, [*group, "start"]).select(*group, F.col("next").alias("start")).checkpoint()
        if further.isEmpty():
            break
        known = known.unionByName(further).checkpoint()
        onward = steps.select(*group, F.col("start").alias("next"), F.col("next").alias("_beyond"))
        steps = steps.join(onward, [*group, "next"]).select(*group, "start", F.col("_beyond").alias("next")).checkpoint()
    return known.select(*group, F.call_function("div", F.col("start"), F.lit(block_us)).alias("_block"), F.col("start").alias("first"))


def _flag(bit: int) -> Column:
    return F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) == bit)


def traffic_characteristics(headers: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """24 characteristics per window, source and destination, from ``decode_headers`` rows with a
    ``window_start``.

    Numbers of ports, types and codes count distinct values.  Their domains are small (65 536 ports at most),
    so a set per group is bounded, and rows are not multiplied as they are for several distinct counts.
    """
    c = F.col

    def distinct(column: str) -> Column:
        return F.size(F.collect_set(column)).cast("bigint")

    return headers.groupBy(*within, "window_start", "srcip", "dstip").agg(
        F.count_if(c("proto") == TCP).alias("tcp_packets"),
        F.count_if(c("proto") == UDP).alias("udp_packets"),
        F.count_if(c("proto") == ICMP).alias("icmp_packets"),
        F.count(F.lit(1)).alias("ip_packets"),
        distinct("srcport").alias("src_ports"), distinct("dstport").alias("dst_ports"),
        *[_flag(FLAG_BITS[n]).alias(f"{n}_flags") for n in ("fin", "syn", "psh", "ack", "urg", "rst")],
        _flag(64).alias("ece_flags"), _flag(128).alias("cwr_flags"),
        distinct("tos").alias("tos_values"),
        F.avg("ttl").alias("mean_ttl"), F.avg("header_len").alias("mean_header_len"),
        F.avg("len").alias("mean_packet_len"),
        F.sum("df").alias("dont_fragment"), F.sum("mf").alias("more_fragments"),
        F.avg("fragment_offset").alias("mean_fragment_offset"), F.avg("data_offset").alias("mean_data_offset"),
        distinct("icmp_type").alias("icmp_types"), distinct("icmp_code").alias("icmp_codes"))
