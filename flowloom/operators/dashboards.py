"""Dashboard queries: each is one aggregate over scored flows.

Filters and the few columns a panel needs reach the scan of a stored table; ``timestamp`` ranges prune its
date partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.columns import geohash2

# Bucket lengths an automatic time axis chooses from.
LADDER = ["1 second", "5 seconds", "10 seconds", "30 seconds", "1 minute", "5 minutes", "10 minutes",
          "30 minutes", "1 hour", "3 hours", "12 hours", "1 day", "7 days", "30 days"]
_SECONDS = [1, 5, 10, 30, 60, 300, 600, 1800, 3600, 10800, 43200, 86400, 604800, 2592000]


def auto_interval(seconds: float, buckets: int = 50) -> str:
    """Shortest ladder step that covers a time span with at most ``buckets`` buckets."""
    for name, length in zip(LADDER, _SECONDS):
        if seconds / length <= buckets:
            return name
    return LADDER[-1]


def by_prediction(scored: DataFrame, predict: int | None = None) -> DataFrame:
    """``predict:1``, ``predict:0`` or everything."""
    return scored if predict is None else scored.filter(F.col("predict") == float(predict))


def _bucketed(scored: DataFrame, interval: str, *aggregates: Column) -> DataFrame:
    return (scored.groupBy(F.window("timestamp", interval).alias("w")).agg(*aggregates)
            .select(F.col("w.start").alias("bucket"), "*").drop("w"))


def analyzed_flows(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("flows"))


def attack_vs_normal(scored: DataFrame, interval: str = "1 hour") -> DataFrame:
    return _bucketed(scored, interval, F.count_if(F.col("predict") == 1).alias("attacks"),
                     F.count_if(F.col("predict") == 0).alias("normal"))


def top_terms(scored: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values; equal counts are ordered by value."""
    return (scored.groupBy(column).agg(F.count(F.lit(1)).alias("flows"))
            .orderBy(F.desc("flows"), F.asc(column)).limit(n))


def _map(scored: DataFrame, location: str, *measures: Column) -> DataFrame:
    lat, lon = F.col(f"{location}.lat"), F.col(f"{location}.lon")
    return scored.groupBy(geohash2(lat, lon).alias("cell")).agg(
        *measures, F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def destination_map(scored: DataFrame) -> DataFrame:
    return _map(by_prediction(scored, 1), "dstlocation", F.count(F.lit(1)).alias("flows"))


def source_map(scored: DataFrame) -> DataFrame:
    return _map(by_prediction(scored, 1), "srclocation", F.count(F.lit(1)).alias("flows"))


def received_bytes_map(scored: DataFrame) -> DataFrame:
    return _map(scored, "dstlocation", F.sum("total_bvolume").alias("received_bytes"))


def packet_series(scored: DataFrame, interval: str = "1 hour") -> DataFrame:
    return _bucketed(scored, interval, F.avg("total_fpackets").alias("avg_fpackets"),
                     F.avg("total_bpackets").alias("avg_bpackets"))


def packet_trend(scored: DataFrame, interval: str = "1 day") -> DataFrame:
    """Packet sums per bucket, with the value of a linear fit over all buckets.

    The fit is a window over the whole series, which has one row per bucket of time.
    """
    sums = _bucketed(scored, interval, F.sum("total_fpackets").alias("fpackets"),
                     F.sum("total_bpackets").alias("bpackets"))
    x, everything = F.unix_seconds("bucket"), Window.partitionBy(F.lit(0))

    def fitted(column: str) -> Column:
        slope = F.regr_slope(column, x).over(everything)
        level = F.avg(column).over(everything)
        return F.coalesce(level + slope * (x - F.avg(x).over(everything)), level).alias(f"{column}_trend")

    return sums.select("bucket", "fpackets", "bpackets", fitted("fpackets"), fitted("bpackets"))


def threats_detected(scored: DataFrame) -> DataFrame:
    return scored.agg(F.sum("predict").alias("threats"))


def traffic_series(scored: DataFrame, interval: str = "1 hour") -> DataFrame:
    return _bucketed(scored, interval, F.sum("total_bvolume").alias("rx_bytes"),
                     F.sum("total_fvolume").alias("tx_bytes"))


def auto_series(scored: DataFrame, buckets: int = 50) -> DataFrame:
    """Attacks, normal flows and bytes over time, in the shortest ladder step that needs at most ``buckets`` buckets.

    Flows are added up by the second first; the step comes from that table, within the same plan.
    """
    fine = scored.groupBy(F.unix_seconds("timestamp").alias("second")).agg(
        F.count_if(F.col("predict") == 1).alias("attacks"), F.count_if(F.col("predict") == 0).alias("normal"),
        F.sum("total_bvolume").alias("rx_bytes"), F.sum("total_fvolume").alias("tx_bytes"))
    span, step = F.max("second") - F.min("second"), F.lit(_SECONDS[-1])
    for length in reversed(_SECONDS[:-1]):
        step = F.when(span <= buckets * length, length).otherwise(step)
    step = fine.agg(step.cast("long").alias("step")).scalar()
    placed = fine.withColumn("step", step).withColumn("bucket", F.col("second") - F.pmod("second", "step"))
    return placed.groupBy("bucket", "step").agg(*[F.sum(c).alias(c) for c in ("attacks", "normal", "rx_bytes", "tx_bytes")]).select(
        F.timestamp_seconds("bucket").alias("bucket"), "step", "attacks", "normal", "rx_bytes", "tx_bytes")


PANELS = {"dst_ip": "dstip", "dst_port": "dstport", "destinations": "dst_cell", "sources": "src_cell", "packet_series": "bucket",
          "threats": None}
_SUMS = ["flows", "attacks", "threats", "fpackets", "bpackets", "lat_sum", "lon_sum"]


def panel_partials(scored: DataFrame, interval: str = "1 hour") -> DataFrame:
    """What the six panels of the overview need of these flows, in one pass: panel, term, bucket and sums.

    One aggregation with a grouping set for each panel. Tables of parts, such as one for each batch, add up
    (``composed``), so a stored overview never reads its flows again.
    """
    attack, cells = F.col("predict") == 1, []
    for end in ("dst", "src"):
        lat, lon = F.col(f"{end}location.lat"), F.col(f"{end}location.lon")
        cells += [geohash2(lat, lon).alias(f"{end}_cell"), lat.alias(f"{end}_lat"), lon.alias(f"{end}_lon")]
    rows = scored.select("dstip", "dstport", "predict", "total_fpackets", "total_bpackets", *cells,
                         F.window("timestamp", interval)["start"].alias("bucket"))
    keys = [c for c in PANELS.values() if c]
    sums = {"flows": F.count(F.lit(1)), "attacks": F.count_if(attack), "threats": F.sum("predict"),
            "fpackets": F.sum("total_fpackets"), "bpackets": F.sum("total_bpackets"),
            **{f"{end}_{c}_sum": F.sum(F.when(attack, F.col(f"{end}_{c}"))) for end in ("dst", "src") for c in ("lat", "lon")}}
    made = rows.groupingSets([[c] if c else [] for c in PANELS.values()], *keys).agg(
        *[value.alias(name) for name, value in sums.items()],
        F.coalesce(*[F.when(F.grouping(c) == 0, name) for name, c in PANELS.items() if c], F.lit("threats")).alias("panel"))
    term = F.coalesce("dstip", F.col("dstport").cast("string"), "dst_cell", "src_cell")
    place = {c: F.when(F.col("panel") == "sources", F.col(f"src_{c}")).otherwise(F.col(f"dst_{c}")).alias(c) for c in ("lat_sum", "lon_sum")}
    return made.select("panel", term.alias("term"), "bucket", *_SUMS[:-2], *place.values())


def composed(partials: DataFrame, n: int = 10) -> DataFrame:
    """The overview from stored parts: panel, term, bucket, value, second, lat, lon.

    ``value`` is the panel's number (flows, threats, or mean forward packets with mean backward ones in ``second``);
    the two lists hold their first ``n`` terms. One scan and one aggregation give all panels: terms are ranked within 64
    parts of a panel before the panel's own ranking, so no task sorts all terms.
    """
    merged = partials.groupBy("panel", "term", "bucket").agg(*[F.sum(c).alias(c) for c in _SUMS])
    merged = merged.where("panel not in ('destinations', 'sources') or attacks > 0")
    listed = F.col("panel").isin("dst_ip", "dst_port")
    order = [F.desc("flows"), F.col("term").try_cast("bigint"), F.asc("term")]
    for by in ([F.pmod(F.xxhash64("term"), F.lit(64))], []):
        place = F.row_number().over(Window.partitionBy("panel", *by).orderBy(*order))
        merged = merged.withColumn("place", place).where(~listed | (F.col("place") <= n))
    mapped, series = F.col("panel").isin("destinations", "sources"), F.col("panel") == "packet_series"
    value = (F.when(listed, F.col("flows")).when(mapped, F.col("attacks")).when(series, F.col("fpackets") / F.col("flows"))
             .otherwise(F.col("threats")))
    return merged.select(
        "panel", "term", "bucket", value.cast("double").alias("value"),
        F.when(series, F.col("bpackets") / F.col("flows")).alias("second"),
        *[F.when(mapped, F.col(f"{c}_sum") / F.col("attacks")).alias(c) for c in ("lat", "lon")])


def blocklist(scored: DataFrame) -> DataFrame:
    """Distinct (source, destination) pairs with a predicted threat."""
    return scored.filter(F.col("predict") != 0).select("srcip", "dstip").distinct()
