import pytest
from helpers import ACK, CLIENT, DATA, FINACK, RST, SYN, URG, frame_of, handshake, tcp, udp

from flowloom.operators import segment
from flowloom.operators.features import emit, expire_idle, flow_records
from flowloom.operators.segment import hot_keys
from flowloom.schema import RECORD_FIELDS
from flowloom.sources.fixtures import packets_from_events

from conftest import SF

TIMEOUT, IDLE = 600_000_000, 1_000_000


def flows(spark, packets, **options):
    return flow_records(frame_of(spark, packets), **options).orderBy("flow_start").collect()


def test_full_connection(spark):
    packets = handshake() + [tcp(5, 40, "c", FINACK), tcp(6, 50, "s", FINACK), tcp(7, 60, "c", ACK)]
    (flow,) = flows(spark, packets)
    assert (flow.status, flow.is_valid, flow.srcip) == ("closed", True, "10.0.0.1")
    assert (flow.total_fpackets, flow.total_bpackets, flow.total_fvolume) == (5, 2, 260)
    assert (flow.fpsh_cnt, flow.bpsh_cnt, flow.duration) == (1, 0, 60)


def test_half_close_stays_open(spark):
    packets = handshake() + [tcp(5, 40, "c", FINACK), tcp(6, 50, "s", ACK), tcp(7, 60, "s", DATA, 90)]
    (flow,) = flows(spark, packets)
    assert flow.status == "open" and flow.total_bpackets == 3


def test_reset_closes_at_once_but_not_on_the_opening_packet(spark):
    a, b = flows(spark, handshake() + [tcp(5, 40, "s", RST), tcp(6, 50, "c", ACK)])
    assert (a.status, a.total_bpackets, b.status, b.total_fpackets) == ("closed", 2, "open", 1)
    a, b = flows(spark, [tcp(1, 0, "c", RST), tcp(2, 10, "s", ACK), tcp(3, 20, "s", ACK)])
    assert (a.status, a.total_fpackets, a.total_bpackets) == ("closed", 1, 1)
    assert (b.srcip, b.total_fpackets) == ("10.0.0.2", 1)


def test_timeout_is_strict(spark):
    (flow,) = flows(spark, [udp(1, 0), udp(2, TIMEOUT, "s")])
    assert flow.total_bpackets == 1 and flow.max_idle == TIMEOUT
    a, b = flows(spark, [udp(1, 0), udp(2, TIMEOUT + 1, "s")])
    assert (a.status, b.status, b.srcip) == ("timed_out", "open", "10.0.0.2")


def test_idle_split_is_strict(spark):
    (one,) = flows(spark, [udp(1, 0), udp(2, IDLE)])
    (two,) = flows(spark, [udp(1, 0), udp(2, IDLE + 1)])
    assert (one.bursts, one.max_fiat, one.max_idle) == (1, IDLE, 0)
    assert (two.bursts, two.max_fiat, two.max_idle, two.sflow_fpackets) == (2, 0, IDLE + 1, 1)


def test_reordered_packet_is_ignored_but_equal_time_is_not(spark):
    (flow,) = flows(spark, [udp(1, 100), udp(2, 99), udp(3, 100), udp(4, 101)])
    assert flow.total_fpackets == 3 and flow.min_fiat == 1


def test_zero_counts_as_unset_minimum(spark):
    (flow,) = flows(spark, [udp(1, 0), udp(2, 5), udp(3, 5), udp(4, 12)])
    assert (flow.min_fiat, flow.max_fiat, flow.mean_fiat, flow.std_fiat) == (7, 7, 4, 3)


def test_one_way_flow(spark):
    (flow,) = flows(spark, [udp(1, 0, length=60), udp(2, 3, length=70)])
    assert (flow.mean_bpktl, flow.min_bpktl, flow.is_valid) == (-1, 0, False)
    assert flow.total_fhlen == 20 + 40 + 20 + 50  # the datagram length counts as header


def test_equal_addresses_keep_directions_apart(spark):
    ends = (CLIENT, (CLIENT[0], 80))
    assert len(flows(spark, [udp(1, 0, "c", ends=ends), udp(2, 5, "s", ends=ends)])) == 2


def test_urgent_counts_and_dscp(spark):
    (flow,) = flows(spark, [tcp(1, 0, "c", SYN), tcp(2, 1, "s", URG, dscp=3), tcp(3, 2, "c", URG), tcp(4, 3, "s", URG, dscp=9)])
    assert (flow.furg_cnt, flow.burg_cnt, flow.dscp) == (1, 2, 3)


def test_long_bursts_do_not_overflow(spark):
    hour = 3_600_000_000
    packets = [udp(i + 1, i * 900_000) for i in range(5000)]
    (flow,) = flows(spark, packets)
    assert flow.duration > hour and flow.max_active == flow.duration and flow.std_fiat == 0


def test_flow_statistics_are_compiled(spark):
    """A generated method above 8000 bytes is never compiled to machine code, but interpreted for each flow."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = flow_records(packets_from_events(spark, SF))._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000


def test_emission_and_expiry(spark):
    table = flow_records(frame_of(spark, [udp(1, 0), udp(2, TIMEOUT + 1), udp(3, TIMEOUT + 2, "s")]))
    assert emit(table, "open").count() == emit(table, "valid").count() == 1
    assert expire_idle(table, 2 * TIMEOUT + 2).count() == 0
    assert expire_idle(table, 2 * TIMEOUT + 3).count() == 1
    with pytest.raises(ValueError):
        emit(table, "some")


@pytest.fixture(scope="module")
def plain(spark):
    rows = flow_records(packets_from_events(spark, SF), hot_rows=None).collect()
    return sorted(rows, key=lambda r: (r.flow_start, r.proto))


@pytest.mark.parametrize("hot_rows, span", [(20, 37), (200, 1000), (1, 8)])
def test_hot_keys_give_the_same_flows(spark, plain, hot_rows, span):
    rows = flow_records(packets_from_events(spark, SF), hot_rows=hot_rows, chunk_span=span).collect()
    assert sorted(rows, key=lambda r: (r.flow_start, r.proto)) == plain


def test_hot_keys_read_the_packets_twice(spark):
    """Once to count the keys, once to mark the packets: what comes after reads what was stored."""
    taken, rows = spark.sparkContext.accumulator(0), packets_from_events(spark, SF)

    def counted(batches):
        for batch in batches:
            taken.add(batch.num_rows)
            yield batch

    flows = flow_records(rows.mapInArrow(counted, rows.schema), hot_rows=20, chunk_span=1000)
    assert flows.count() > 0
    assert taken.value == 2 * rows.count()


@pytest.mark.parametrize("limit", [1, 16])
def test_clocks_that_jump(spark, limit):
    rows = packets_from_events(spark, SF).selectExpr(
        "* except (ts_us)", "ts_us + if(num % 1688 = 800, 3600000000, 0) as ts_us")
    plain = flow_records(rows, hot_rows=None)
    chunked = flow_records(rows, hot_rows=20, chunk_span=100, head_limit=limit)
    assert sorted(map(str, chunked.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_rounds_do_not_grow_with_the_chunks_after_a_jump(spark, monkeypatch, rounds):
    """One clock jumps an hour ahead; its flow is reset, and the other clocks take 60 chunks without reaching that hour."""
    packets = [tcp(0, 0, "c", SYN), tcp(1, 3_600_000_000, "c", SYN), tcp(2, 3_600_000_001, "c", RST)]
    packets += [tcp(n, n * 1000, "cs"[n % 2], [SYN, ACK, DATA, URG, RST, SYN, ACK][n % 7], 40 + n % 7) for n in range(3, 600)]
    rows, followed, inner = frame_of(spark, packets), [], segment.go_through
    monkeypatch.setattr(segment, "ROUNDS", rounds, raising=False)
    monkeypatch.setattr(segment, "go_through", lambda *a: followed.append(1) or inner(*a))
    chunked = flow_records(rows, hot_rows=20, chunk_span=10, head_limit=2)
    assert sorted(map(str, chunked.collect())) == sorted(map(str, flow_records(rows, hot_rows=None).collect()))
    assert len(followed) <= rounds


def test_a_large_key_is_hot_whatever_the_total(spark):
    packets = [udp(i, i * 10) for i in range(40)] + [
        udp(1000 + i, i * 10, ends=((f"10.1.{i // 250}.{i % 250}", 5), ("10.2.2.2", 6))) for i in range(3000)]
    assert [r.ip_a for r in hot_keys(frame_of(spark, packets), hot_rows=30).collect()] == ["10.0.0.1"]
    assert hot_keys(frame_of(spark, packets), hot_rows=40) is None


def test_row_order_does_not_matter(spark, plain):
    rows = flow_records(packets_from_events(spark, SF).orderBy("len", "ts_us").repartition(3)).collect()
    assert sorted(rows, key=lambda r: (r.flow_start, r.proto)) == plain


def test_record_has_every_field(plain):
    assert list(plain[0].asDict())[:45] == RECORD_FIELDS and len(RECORD_FIELDS) == 45

