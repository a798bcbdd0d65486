"""Geo enrichment: address to location through a table of address ranges."""

from __future__ import annotations

import heapq
import sys

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.columns import UNKNOWN_LAT, UNKNOWN_LON, ip_to_long
from flowloom.session import shared_folder

register_pickle_by_value(sys.modules[__name__])

#: Up to this many pieces the cut table is broadcast (about 40 bytes each).
BROADCAST_PIECES = 1_000_000
BLOCK = 65536
_PIECE = "block long, lo long, hi long, lat double, lon double"


def _pieces(ranges: DataFrame) -> DataFrame:
    """Ranges cut at blocks of 65 536 addresses, so that the range condition becomes an equality.

    At most one piece for each block that a range covers or touches: with ranges that don't overlap, no more
    than the blocks there are (65 536) and twice the ranges.
    """
    c = F.col
    return ranges.select("lat", "lon", "ip_from", "ip_to", F.explode(F.sequence(
        F.shiftright("ip_from", 16), F.shiftright("ip_to", 16))).alias("block")).select(
            "block", F.greatest("ip_from", c("block") * BLOCK).alias("lo"),
            F.least("ip_to", c("block") * BLOCK + BLOCK - 1).alias("hi"), "ip_from", "ip_to", "lat", "lon")


def narrowest(frame: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one block, without overlaps: every address goes to the narrowest range that holds it (of equally
    narrow ones the later, then the smaller location). A sweep with a heap of the ranges that are open."""
    rows = sorted((r.lo, r.ip_to - r.ip_from, -r.ip_from, r.lat, r.lon, r.hi) for r in frame.itertuples())
    out, opened, block, i, at = [], [], int(frame["block"].iloc[0]), 0, 0
    while i < len(rows) or opened:
        if not opened:
            at = rows[i][0]
        while i < len(rows) and rows[i][0] <= at:
            heapq.heappush(opened, rows[i][1:])
            i += 1
        while opened and opened[0][-1] < at:
            heapq.heappop(opened)
        if opened:
            _, _, lat, lon, hi = opened[0]
            stop = min(hi, rows[i][0] - 1) if i < len(rows) else hi
            if out and out[-1][2] == at - 1 and out[-1][3:] == (lat, lon):
                out[-1] = (block, out[-1][1], stop, lat, lon)
            else:
                out.append((block, at, stop, lat, lon))
            at = stop + 1
    return pd.DataFrame(out, columns=["block", "lo", "hi", "lat", "lon"])


def unusable_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges that no address can be looked up in, with the ``reason``; ``locate`` leaves them out."""
    reason = (F.when(F.col("ip_from").isNull() | F.col("ip_to").isNull(), "no address")
              .when(F.col("ip_from") > F.col("ip_to"), "reversed")
              .when(F.col("lat").isNull() | F.col("lon").isNull(), "no location"))
    return ranges.withColumn("reason", reason).filter("reason is not null")


def checked_pieces(ranges: DataFrame) -> DataFrame:
    """The cut table (block, lo, hi, location), marked for broadcast if its size allows.

    Ranges may be nested or overlap; then each block is flattened on its own, so that an address has one location. A task
    holds the ranges of one block of 65 536 addresses. ``unusable_ranges`` has what is left out.
    """
    shared_folder(ranges.sparkSession)
    good = ranges.filter("ip_from <= ip_to and lat is not null and lon is not null")
    pieces = _pieces(good).checkpoint()
    order = Window.partitionBy("block").orderBy("lo", "hi")
    clash = pieces.withColumn("before", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows, overlaps = clash.agg(F.count(F.lit(1)), F.count_if(F.col("before") >= F.col("lo"))).first()
    if overlaps:
        pieces = pieces.groupBy("block").applyInPandas(narrowest, _PIECE).checkpoint()
        rows = pieces.count()
    table = pieces.select("block", "lo", "hi", F.struct("lat", "lon").alias("location"))
    return F.broadcast(table) if rows <= BROADCAST_PIECES else table


def _locate(df: DataFrame, pieces: DataFrame, address: str, output: str) -> DataFrame:
    taken = [c for c in df.columns if c != output]
    found = df.withColumn("_ip", ip_to_long(F.col(address))).join(
        pieces.select(F.col("block").alias("_block"), "lo", "hi", F.col("location").alias("_found")),
        (F.shiftright("_ip", 16) == F.col("_block")) & F.col("_ip").between(F.col("lo"), F.col("hi")), "left")
    default = F.struct(F.lit(UNKNOWN_LAT).alias("lat"), F.lit(UNKNOWN_LON).alias("lon"))
    return found.select(*taken, F.coalesce("_found", default).alias(output))


def locate(df: DataFrame, ranges: DataFrame, address: str, output: str) -> DataFrame:
    """Add ``output`` STRUCT<lat, lon> for an address column; unknown addresses get the default location.

    ``ranges`` (ip_from, ip_to, lat, lon; inclusive; the narrowest range counts).  One join per address, against a table
    whose size is counted first: broadcast while it is small, by block otherwise (AQE splits hot blocks).
    """
    return _locate(df, checked_pieces(ranges), address, output)


def add_locations(flows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``srclocation`` and ``dstlocation``, each from its own address."""
    pieces = checked_pieces(ranges)
    return _locate(_locate(flows, pieces, "srcip", "srclocation"), pieces, "dstip", "dstlocation")
