"""Packet operators: frame decoding, canonical keys, flag tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.columns import bits, dotted, once, unsigned
from flowloom.schema import PACKET_SCHEMA

# Protocol numbers, header sizes and frame layout.
ICMP, TCP, UDP = 1, 6, 17
IP_AT = 14
SHORTEST_FRAME = 34
TCP_HEADER, UDP_HEADER = 20, 8
FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}

KEY = ["ip_a", "port_a", "ip_b", "port_b", "proto"]


def has_flag(flags: Column, name: str) -> Column:
    """All bits of the named TCP flag are set."""
    bits = FLAG_BITS[name]
    return flags.bitwiseAND(F.lit(bits)) == bits


def is_ipv4_frame(frame: Column) -> Column:
    return frame.substr(13, 2) == F.lit(b"\x08\x00")


def to_micros(seconds: Column) -> Column:
    """Seconds to whole microseconds, truncated."""
    return (seconds * 1000000).cast("bigint")


def short_frames(frames: DataFrame) -> DataFrame:
    """IPv4 frames too short to hold an IP header, with the reason."""
    return (frames.filter(is_ipv4_frame(F.col("frame")) & (F.length("frame") < SHORTEST_FRAME))
            .withColumn("reason", F.lit("short_ip_header")))


def _ipv4(frames: DataFrame, **more: Column) -> DataFrame:
    """IPv4 frames with their fixed header read as a few whole numbers, each exactly once per row.

    A frame that is itself computed is too: else each filter and each field would compute it anew.
    """
    frames, frame = frames.withColumn("frame", once(F.col("frame"))), F.col("frame")
    words = {"w0": unsigned(frame, IP_AT, 4), "w1": unsigned(frame, IP_AT + 9, 7),
             "dst": unsigned(frame, IP_AT + 16, 4), "left": F.length(frame), **more}
    read = F.inline(F.array(F.struct(*[v.alias(n) for n, v in words.items()])))
    return (frames.filter(is_ipv4_frame(frame) & (F.length(frame) >= SHORTEST_FRAME))
            .select("*", read)
            .filter(bits("w0", 28, 4) == 4)
            .withColumns({"proto": bits("w1", 48, 8).cast("int"), "iphlen": (bits("w0", 24, 4) * 4).cast("int"),
                          "src": bits("w1", 0, 32)})
            .withColumn("at", F.lit(IP_AT) + F.col("iphlen"))
            .withColumn("left", F.col("left") - F.col("at")))


def decode_frames(frames: DataFrame) -> DataFrame:
    """Ethernet frames to decoded TCP and UDP packets.  Other frames are dropped.

    Each filter comes before the decoding that needs it, and other columns of ``frames`` (a capture id,
    say) are kept.
    """
    frame, at, tcp = F.col("frame"), F.col("at"), F.col("proto") == TCP
    rest = [c for c in frames.columns if c not in {"num", "ts", "frame"}]
    ip = (_ipv4(frames).filter(F.col("proto").isin(TCP, UDP))
          .filter(F.col("left") >= F.when(tcp, TCP_HEADER).otherwise(UDP_HEADER))
          .withColumns({"ports": unsigned(frame, at, 4),
                        # offset and flags of TCP, datagram length of UDP
                        "tail": unsigned(frame, at + F.when(tcp, 12).otherwise(4), 2)}))
    return ip.select(
        "num", to_micros(F.col("ts")).alias("ts_us"),
        dotted(F.col("src")).alias("srcip"), bits("ports", 16, 16).cast("int").alias("srcport"),
        dotted(F.col("dst")).alias("dstip"), bits("ports", 0, 16).cast("int").alias("dstport"),
        "proto", "iphlen",
        # UDP reports its datagram length here; the header totals of a flow depend on it
        F.when(tcp, bits("tail", 12, 4) * 4).otherwise(F.col("tail")).cast("int").alias("prhlen"),
        bits("w0", 0, 16).cast("int").alias("len"), bits("w0", 18, 6).cast("int").alias("dscp"),
        F.when(tcp, bits("tail", 0, 6)).otherwise(0).cast("int").alias("flags"),
        *rest)


def decode_headers(frames: DataFrame) -> DataFrame:
    """IPv4 frames of any protocol to the header fields that traffic characteristics need.

    Transport fields are NULL where the protocol has none or the frame is too short for them.
    """
    frame, at, left, proto = F.col("frame"), F.col("at"), F.col("left"), F.col("proto")
    rest = [c for c in frames.columns if c not in {"num", "ts", "frame"}]
    tcp = (proto == TCP) & (left >= TCP_HEADER)
    ports = tcp | ((proto == UDP) & (left >= UDP_HEADER))
    icmp = (proto == ICMP) & (left >= 2)
    ip = _ipv4(frames, w4=unsigned(frame, IP_AT + 6, 3)).withColumns({
        "ports": F.when(ports, unsigned(frame, at, 4)), "tail": F.when(tcp, unsigned(frame, at + 12, 2)),
        "kind": F.when(icmp, unsigned(frame, at, 2))})
    fields = {
        "tos": bits("w0", 16, 8), "ttl": bits("w4", 0, 8), "header_len": F.col("iphlen"), "len": bits("w0", 0, 16),
        "df": bits("w4", 22, 1), "mf": bits("w4", 21, 1), "fragment_offset": bits("w4", 8, 13),
        "srcport": bits("ports", 16, 16), "dstport": bits("ports", 0, 16), "data_offset": bits("tail", 12, 4),
        "flags": bits("tail", 0, 8), "icmp_type": bits("kind", 8, 8), "icmp_code": bits("kind", 0, 8),
    }
    return ip.select(
        "num", to_micros(F.col("ts")).alias("ts_us"), dotted(F.col("src")).alias("srcip"),
        dotted(F.col("dst")).alias("dstip"), "proto", *[v.cast("int").alias(n) for n, v in fields.items()], *rest)


def encode_frames(packets: DataFrame) -> DataFrame:
    """Packets to minimal Ethernet frames (headers only), the inverse of ``decode_frames``.

    ``ttl``, ``fragment`` (flags and offset), ``icmp_type`` and ``icmp_code`` are used where present.
    """
    def hexed(value: Column, width: int) -> Column:
        return F.lpad(F.hex(value.cast("bigint")), width * 2, "0")

    def address(ip: Column) -> Column:
        return F.concat(*[hexed(F.split_part(ip, F.lit("."), F.lit(i)), 1) for i in range(1, 5)])

    def optional(name: str, default: int) -> Column:
        return F.col(name) if name in packets.columns else F.lit(default)

    c = F.col
    ip = F.concat(
        F.lit("00" * 12 + "0800"),
        hexed(F.lit(64) + F.call_function("div", c("iphlen"), F.lit(4)), 1),
        hexed(c("dscp") * 4, 1), hexed(c("len"), 2), F.lit("0000"), hexed(optional("fragment", 0), 2),
        hexed(optional("ttl", 64), 1), hexed(c("proto"), 1), F.lit("0000"),
        address(c("srcip")), address(c("dstip")), F.repeat(F.lit("00"), c("iphlen") - 20))
    ports = F.concat(hexed(c("srcport"), 2), hexed(c("dstport"), 2))
    tcp = F.concat(ports, F.lit("00" * 8), hexed(c("prhlen") * 4, 1), hexed(c("flags"), 1), F.lit("00" * 6))
    udp = F.concat(ports, hexed(c("prhlen"), 2), F.lit("0000"))
    icmp = F.concat(hexed(optional("icmp_type", 0), 1), hexed(optional("icmp_code", 0), 1), F.lit("00" * 6))
    used = {*PACKET_SCHEMA.names, "ttl", "fragment", "icmp_type", "icmp_code"}
    return packets.select(
        "num", (c("ts_us") / 1000000).alias("ts"),
        once(F.unhex(F.concat(ip, F.when(c("proto") == TCP, tcp).when(c("proto") == UDP, udp).otherwise(icmp))))
        .alias("frame"), *[x for x in packets.columns if x not in used])


def strip_encapsulation(frames: DataFrame, outer: str = "gre") -> DataFrame:
    """Keep what a GRE or NSH header carries, re-based to an Ethernet frame; other frames are dropped.

    GRE: IPv4 protocol 47, the header grows by 4 bytes for each of its checksum, key and sequence bits.
    NSH: Ethernet type 0x894F, header length in the low six bits of its second byte, in 4-byte words.
    """
    frame = F.col("frame")
    if outer == "gre":
        at = F.lit(IP_AT) + unsigned(frame, IP_AT, 1).bitwiseAND(F.lit(15)) * 4
        flags = unsigned(frame, at, 1)
        size = F.lit(4) + sum((F.shiftright(flags, b).bitwiseAND(F.lit(1)) * 4 for b in (7, 5, 4)), F.lit(0))
        kept = frames.filter(is_ipv4_frame(frame) & (F.length(frame) >= SHORTEST_FRAME)
                             & (unsigned(frame, IP_AT + 9, 1) == 47))
        kind = unsigned(frame, at + 2, 2)
        ethernet, ipv4 = kind == 0x6558, kind == 0x0800
    elif outer == "nsh":
        at = F.lit(IP_AT)
        size = unsigned(frame, IP_AT + 1, 1).bitwiseAND(F.lit(63)) * 4
        kept = frames.filter(frame.substr(13, 2) == F.lit(b"\x89\x4f"))
        kind = unsigned(frame, IP_AT + 3, 1)
        ethernet, ipv4 = kind == 3, kind == 1
    else:
        raise ValueError(f"unknown encapsulation {outer!r}")
    inner = frame.substr((at + size + 1).cast("int"), F.length(frame))
    # a bare IPv4 payload gets the outer addresses back in front of it
    rebuilt = F.when(ethernet, inner).when(ipv4, F.concat(frame.substr(1, 12), F.lit(b"\x08\x00"), inner))
    return kept.withColumn("frame", once(rebuilt)).filter(F.col("frame").isNotNull())


def canonical(packets: DataFrame) -> DataFrame:
    """Add the direction-free key and ``side``: 0 when the packet left the key's first endpoint, else 1.

    Endpoints are ordered by address text; equal addresses are not swapped, so their two directions stay
    apart.
    """
    swap = F.col("dstip") < F.col("srcip")

    def pick(when_swapped: str, otherwise: str) -> Column:
        return F.when(swap, F.col(when_swapped)).otherwise(F.col(otherwise))

    return packets.select(
        "*",
        pick("dstip", "srcip").alias("ip_a"), pick("dstport", "srcport").alias("port_a"),
        pick("srcip", "dstip").alias("ip_b"), pick("srcport", "dstport").alias("port_b"),
        F.when(swap, 1).otherwise(0).alias("side"))
