"""A key's chunks, summarised apart and chained, leave the same state as one pass over its packets."""

from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.functions.tracking import (ADDED, BOTH_CLOSED, CLOSED, ESTABLISHED, FINISHING, START, SYN_ACKED,
                                         SYN_SENT, UDP_SYMBOL, ChunkSummary, Track, apply_summary, endpoint_next,
                                         follow)

TIMEOUT, IDLE = 1000, 100

steps = st.tuples(st.sampled_from([0, 1, 5, 20, -7, -300, 150, 1000, 1001, 4000, -4000]), st.integers(0, 1),
                  st.sampled_from([2, 18, 16, 24, 17, 17, 4, 0, 1]), st.sampled_from([0, 5, 7, 40]))


def _replay(track, packets):
    for packet in packets:
        if track.step(*packet) == ADDED and track.pairs[0] == BOTH_CLOSED:
            track.pairs = None


@settings(max_examples=400, deadline=None)
@given(st.lists(steps, min_size=2, max_size=60), st.integers(1, 9), st.booleans(),
       st.sampled_from([0, 1, 2, 4096]))
def test_chunks_compose(moves, size, is_udp, limit):
    packets, ts = [], 5000
    for num, (move, side, flags, length) in enumerate(moves):
        ts = max(0, ts + move)
        packets.append((num, ts, side, UDP_SYMBOL if is_udp else side * 64 + flags, length))
    whole, chained, peak = Track(TIMEOUT, IDLE), Track(TIMEOUT, IDLE), None
    for begin in range(0, len(packets), size):
        chunk = packets[begin:begin + size]
        summary = ChunkSummary(peak, TIMEOUT, IDLE, limit)
        for packet in chunk:
            summary.add(*packet)
        assert len(summary.head) <= max(limit, 1)
        entry = Track.from_row(chained.to_row(), TIMEOUT, IDLE)
        chained = apply_summary(chained, summary.to_row())
        if chained is None:  # the summary can't tell: through the chunk
            chained = entry
            for packet in chunk:
                follow(chained, *packet)
        _replay(whole, chunk)
        peak = max([p[1] for p in chunk] + ([] if peak is None else [peak]))
        if whole.pairs is None:
            assert chained.pairs is None
        else:
            assert chained.to_row() == whole.to_row()
        chained = Track.from_row(chained.to_row(), TIMEOUT, IDLE)


def test_machine_rules():
    for state in range(6):
        assert endpoint_next(state, 4, True) == endpoint_next(state, 4, False) == CLOSED
        assert endpoint_next(state, 1, True) == FINISHING
    assert endpoint_next(START, 2, True) == SYN_SENT
    assert endpoint_next(START, 2, False) == START
    assert endpoint_next(SYN_SENT, 18, False) == SYN_ACKED
    assert endpoint_next(SYN_SENT, 2, False) == SYN_SENT
    assert endpoint_next(SYN_ACKED, 16, True) == ESTABLISHED
    assert endpoint_next(FINISHING, 16, False) == CLOSED
    assert endpoint_next(FINISHING, 16, True) == FINISHING
    assert endpoint_next(ESTABLISHED, 24, False) == ESTABLISHED
