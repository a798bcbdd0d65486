import struct

import pytest
from pyspark.sql import functions as F

from helpers import frame_of, tcp, udp

from flowloom.operators.packets import (canonical, decode_frames, decode_headers, encode_frames, short_frames,
                                        strip_encapsulation)
from flowloom.operators.windows import anchored_windows
from flowloom.schema import FRAME_SCHEMA, PACKET_SCHEMA
from flowloom.sources.captures import cut_captures, read_captures

IPV4 = b"\0" * 12 + b"\x08\x00"


def frames_of(spark, *frames):
    return spark.createDataFrame([(i + 1, float(i), f) for i, f in enumerate(frames)], FRAME_SCHEMA)


def ip(proto, payload, version=4):
    return IPV4 + bytes([version << 4 | 5, 0]) + struct.pack(">H", 20 + len(payload)) + bytes(5) + bytes([proto]) + \
        bytes(2) + bytes([200, 0, 0, 1, 250, 1, 2, 3]) + payload


def test_round_trip(spark):
    rows = [tcp(1, 1_000_000, flags=24, dscp=5), udp(2, 2_000_000, "s")]
    out = decode_frames(encode_frames(frame_of(spark, rows))).select(*PACKET_SCHEMA.names).orderBy("num").collect()
    assert [tuple(r) for r in out] == rows


def test_unwanted_frames(spark):
    good = ip(17, struct.pack(">HHHH", 53, 54, 9, 0))
    table = frames_of(spark, good, IPV4 + bytes(10), b"\0" * 12 + b"\x86\xdd" + bytes(40), ip(1, bytes(8)),
                      ip(6, bytes(12)), ip(17, bytes(8), version=6))
    (row,) = decode_frames(table).collect()
    assert (row.num, row.srcip, row.dstip, row.prhlen) == (1, "200.0.0.1", "250.1.2.3", 9)
    assert [r.num for r in short_frames(table).collect()] == [2]
    assert {r.proto for r in decode_headers(table).collect()} == {1, 6, 17}


def test_encapsulation(spark):
    inner = ip(17, struct.pack(">HHHH", 53, 54, 9, 0))
    gre = ip(47, b"\x00\x00\x65\x58" + inner)
    nsh = b"\0" * 12 + b"\x89\x4f" + b"\x00\x02\x01\x03" + bytes(4) + inner
    table = frames_of(spark, gre, nsh, inner)
    assert [r.num for r in decode_frames(strip_encapsulation(table, "gre")).collect()] == [1]
    assert [r.num for r in decode_frames(strip_encapsulation(table, "nsh")).collect()] == [2]


def test_canonical_key(spark):
    a, b = canonical(frame_of(spark, [tcp(1, 0, "c"), tcp(2, 0, "s")])).orderBy("num").collect()
    assert (a.ip_a, a.port_a, a.ip_b, a.port_b) == (b.ip_a, b.port_a, b.ip_b, b.port_b)
    assert {a.side, b.side} == {0, 1}


@pytest.mark.parametrize("span", [40, 333, 1000, 1 << 26])
def test_capture_files(spark, tmp_path, span):
    """Both byte orders, records across stretches, contents that look like headers, a cut end."""
    like = struct.pack("<IIII", 5, 6, 7, 8) * 6
    frames = [ip(17, struct.pack(">HHHH", 53, 54, 9, 0) + bytes(i % 7) + (like if i % 11 == 0 else b"")) for i in range(300)]
    for name, order in (("a.pcap", "<"), ("b.pcap", ">")):
        with open(tmp_path / name, "wb") as out:
            out.write(struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            for i, frame in enumerate(frames):
                out.write(struct.pack(order + "IIII", 100 + i, i, len(frame), len(frame)) + frame)
            end = out.tell()
            out.write(b"cut" if name == "a.pcap" else b"")
    rows = read_captures(spark, str(tmp_path), span).collect()
    for name in ("a.pcap", "b.pcap"):
        mine = sorted((r for r in rows if r.capture.endswith(name)), key=lambda r: r.num)
        assert [r.num for r in mine] == list(range(1, 301))
        assert [bytes(r.frame) for r in mine] == frames
        assert mine[9].ts == 109 + 9 / 1_000_000
    (cut,) = cut_captures(spark, str(tmp_path), span).collect()
    assert cut.capture.endswith("a.pcap") and cut.offset == end


def _chain(packets, width):
    out, start = {}, None
    for num, ts in packets:
        if start is None or ts > start + width:
            start = ts
        out[num] = start
    return out


def test_anchored_windows_follow_arrival(spark):
    import random
    r = random.Random(5)
    ts, rows = 0, []
    for num in range(800):
        ts += r.choice([0, 1, 3, 9, 40, -15, 400 if r.random() < 0.1 else 2])
        rows.append((num, max(ts, 0), num % 2))
    table = spark.createDataFrame(rows, "num bigint, ts_us bigint, capture int")
    want = {}
    for capture in (0, 1):
        want |= _chain([(n, t) for n, t, c in rows if c == capture], 50)
    for blocks in (1, 3, 256):
        placed = anchored_windows(table, ["capture"], 50, scan_span=16, block_windows=blocks)
        assert {x.num: x.window_start for x in placed.collect()} == want


def test_anchored_windows_without_silence(spark):
    import random
    r = random.Random(8)
    ts, rows = 0, []
    for num in range(4000):
        ts += r.choice([1, 2, 3])
        rows.append((num, ts))
    table = spark.createDataFrame(rows, "num bigint, ts_us bigint")
    placed = anchored_windows(table, [], 50, scan_span=64, block_windows=4)
    assert {x.num: x.window_start for x in placed.collect()} == _chain(rows, 50)


def test_anchored_windows_of_many_blocks(spark):
    """Thousands of blocks, some of them empty, found in a dozen rounds of doubling."""
    import random
    r = random.Random(3)
    ts, rows = 0, []
    for num in range(9000):
        ts += r.choice([1, 20, 45, 60, 900 if r.random() < 0.05 else 7])
        rows.append((num, ts))
    assert ts // 50 > 1 << 12
    table = spark.createDataFrame(rows, "num bigint, ts_us bigint")
    placed = anchored_windows(table, [], 50, scan_span=512, block_windows=1)
    assert {x.num: x.window_start for x in placed.collect()} == _chain(rows, 50)


def test_a_computed_frame_is_computed_once(spark):
    frames = spark.createDataFrame([(1, 0.0, b"")], "num long, ts double, frame binary")
    computed = frames.withColumn("frame", F.concat("frame", F.sha2(F.col("frame"), 256).cast("binary")))
    for decode in (decode_frames, decode_headers):
        assert decode(computed)._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
