"""Hand-written packets, and a plain sequential meter to check against."""

from flowloom.schema import PACKET_SCHEMA

CLIENT, SERVER = ("10.0.0.1", 1000), ("10.0.0.2", 80)
SYN, SYNACK, ACK, DATA, FINACK, RST, URG = 2, 18, 16, 24, 17, 4, 48


def tcp(num, ts, sender="c", flags=ACK, length=40, dscp=0, ends=(CLIENT, SERVER)):
    a, b = ends if sender == "c" else ends[::-1]
    return (num, ts, a[0], a[1], b[0], b[1], 6, 20, 20, length, dscp, flags)


def udp(num, ts, sender="c", length=60, dscp=0, ends=(CLIENT, SERVER)):
    a, b = ends if sender == "c" else ends[::-1]
    return (num, ts, a[0], a[1], b[0], b[1], 17, 20, length - 20, length, dscp, 0)


def frame_of(spark, packets):
    return spark.createDataFrame(packets, PACKET_SCHEMA)


def handshake(start=1, at=0):
    return [tcp(start, at, "c", SYN), tcp(start + 1, at + 10, "s", SYNACK), tcp(start + 2, at + 20, "c", ACK),
            tcp(start + 3, at + 30, "c", DATA, 100)]
