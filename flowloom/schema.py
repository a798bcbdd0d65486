"""Schemas of packets, flow records and scored documents."""

from __future__ import annotations

from pyspark.sql import types as T

KEY_FIELDS = ["srcip", "srcport", "dstip", "dstport"]

# Names and order of the flow record on the wire.
STAT_FIELDS = [
    "total_fpackets", "total_fvolume", "total_bpackets", "total_bvolume",
    "min_fpktl", "mean_fpktl", "max_fpktl", "std_fpktl",
    "min_bpktl", "mean_bpktl", "max_bpktl", "std_bpktl",
    "min_fiat", "mean_fiat", "max_fiat", "std_fiat",
    "min_biat", "mean_biat", "max_biat", "std_biat",
    "duration",
    "min_active", "mean_active", "max_active", "std_active",
    "min_idle", "mean_idle", "max_idle", "std_idle",
    "sflow_fpackets", "sflow_fbytes", "sflow_bpackets", "sflow_bbytes",
    "fpsh_cnt", "bpsh_cnt", "furg_cnt", "burg_cnt",
    "total_fhlen", "total_bhlen",
]
RECORD_FIELDS = [*KEY_FIELDS, "proto", *STAT_FIELDS, "dscp"]
WIRE_FIELDS = [*RECORD_FIELDS, "class"]
MODEL_FIELDS = RECORD_FIELDS[4:]

_INT_FIELDS = {"srcport", "dstport", "proto", "dscp"}
_TEXT_FIELDS = {"srcip", "dstip", "class"}


def _wire_type(name: str) -> T.DataType:
    if name in _TEXT_FIELDS:
        return T.StringType()
    return T.IntegerType() if name in _INT_FIELDS else T.LongType()


WIRE_SCHEMA = T.StructType([T.StructField(n, _wire_type(n)) for n in WIRE_FIELDS])
RECORD_SCHEMA = T.StructType([T.StructField(n, _wire_type(n)) for n in RECORD_FIELDS])

FRAME_SCHEMA = T.StructType([
    T.StructField("num", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("frame", T.BinaryType()),
])

PACKET_SCHEMA = T.StructType([
    T.StructField("num", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("srcip", T.StringType()),
    T.StructField("srcport", T.IntegerType()),
    T.StructField("dstip", T.StringType()),
    T.StructField("dstport", T.IntegerType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("iphlen", T.IntegerType()),
    T.StructField("prhlen", T.IntegerType()),
    T.StructField("len", T.IntegerType()),
    T.StructField("dscp", T.IntegerType()),
    T.StructField("flags", T.IntegerType()),
])

DICTIONARY_SCHEMA = T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
])

LOCATION = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

GEO_SCHEMA = T.StructType([
    T.StructField("ip_from", T.LongType()),
    T.StructField("ip_to", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])
