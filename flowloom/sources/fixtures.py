"""Packets and ranges derived from the driver tables, for tests, benchmarks and registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.schema import GEO_SCHEMA

ORIGIN_US = 1704067200000000

# Fixed values: (first address, last address, latitude, longitude); some addresses are uncovered on purpose.
GEO_RANGES = [
    ("10.0.0.0", "10.0.0.255", -22.9, -43.2),
    ("10.0.1.0", "10.0.1.255", 40.7, -74.0),
    ("10.0.2.0", "10.0.2.255", 51.5, -0.1),
    ("10.1.0.0", "10.1.0.15", 35.7, 139.7),
    ("10.1.0.16", "10.1.0.31", -33.9, 151.2),
    ("10.9.0.0", "10.9.255.255", 0.0, 0.0),
]

# Ranges within ranges, some that cross, two of one size, and one whose ends are the wrong way round.
NESTED_RANGES = [
    ("10.0.0.0", "10.255.255.255", 1.0, 1.0),
    ("10.0.0.0", "10.0.255.255", 2.0, 2.0),
    ("10.0.1.0", "10.0.1.255", 3.0, 3.0),
    ("10.0.1.16", "10.0.1.23", 4.0, 4.0),
    ("10.0.1.20", "10.0.1.27", 5.0, 5.0),
    ("10.0.1.5", "10.0.1.5", 6.0, 6.0),
    ("10.0.2.0", "10.0.3.20", 7.0, 7.0),
    ("10.1.0.0", "10.1.0.31", 8.0, 8.0),
    ("10.1.0.8", "10.1.0.23", 9.0, 9.0),
    ("10.1.0.40", "10.1.0.32", 10.0, 10.0),
]


def packets_from_events(spark: SparkSession, sf_dir: str, many_keys: bool = False) -> DataFrame:
    """Each event becomes a burst of one to six packets between a client and a server.

    Time is compressed 200 times so that flow timeouts and idle gaps both occur; bursts with one timestamp,
    reordered packets and resets on the first packet are included.  There are about 80 keys, or with ``many_keys``
    as many as users (up to 40 000).
    """
    c = F.col
    event = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.floor("value").cast("int").alias("size"),
        F.call_function("div", F.unix_micros(c("ts").cast("timestamp")) - ORIGIN_US, F.lit(200)).alias("t0"),
        (c("user_id") % 40).alias("k"),
        (c("user_id") % 40_000 if many_keys else c("user_id") % 40).alias("port"), F.when(c("user_id") % 3 == 0, 17).otherwise(6).alias("proto"))
    e, i, k, udp = c("event_id"), c("i"), c("k"), c("proto") == 17
    step = (F.when(e % 13 == 0, 0).when((e % 11 == 0) & (i == 2), -3000).otherwise((e % 7 + 1) * 40000))
    client = F.concat(F.lit("10.0."), (k % 4).cast("string"), F.lit("."), (k + 1).cast("string"))
    server = F.concat(F.lit("10.1.0."), (k + 1).cast("string"))
    client_port, server_port = (c("port") + 1024).cast("int"), F.when(udp, 53).otherwise(443)
    reply = i % 2 == 1
    return (event.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), e % 6))).select(
        (e * 8 + i).alias("num"),
        (c("t0") + i * step + ORIGIN_US).alias("ts_us"),
        F.when(reply, server).otherwise(client).alias("srcip"),
        F.when(reply, server_port).otherwise(client_port).alias("srcport"),
        F.when(reply, client).otherwise(server).alias("dstip"),
        F.when(reply, client_port).otherwise(server_port).alias("dstport"),
        "proto", F.lit(20).alias("iphlen"),
        F.when(udp, c("size") + 8).otherwise(20).alias("prhlen"),
        (c("size") + F.when(udp, 28).otherwise(40)).alias("len"),
        F.when(e % 5 == 0, 10).otherwise(0).alias("dscp"),
        F.when(udp, 0).when((i == 0) & (e % 17 == 0), 4).when(i == 0, 2).when(i == 1, 18).when(i == 2, 16)
        .when(i == 3, 24).when((i == 4) & (e % 3 == 0), 4).otherwise(17).alias("flags")))


def _address_value(ip: str) -> int:
    value = 0
    for part in ip.split("."):
        value = value * 256 + int(part)
    return value


def geo_ranges(spark: SparkSession, ranges: list[tuple] = GEO_RANGES) -> DataFrame:
    """The small range table as a DataFrame."""
    rows = [(_address_value(a), _address_value(b), lat, lon) for a, b, lat, lon in ranges]
    return spark.createDataFrame(rows, GEO_SCHEMA)
