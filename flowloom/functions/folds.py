"""Arrow-batch drivers of ``tracking``, run inside tasks.

Imports stay light on purpose: every Python worker loads this module.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Sequence

import pyarrow as pa

from flowloom.functions.tracking import (ADDED, BOTH_CLOSED, CLIENT_READY, DROPPED, EXPIRED, HEAD_LIMIT,
                                         ChunkSummary, Track, apply_summary, follow)

# column, Arrow type and SQL type of what ``label`` adds
LABELS = [
    ("flow_start", pa.int64(), "bigint"), ("front", pa.int8(), "tinyint"), ("gap", pa.int64(), "bigint"),
    ("iat", pa.int64(), "bigint"), ("span", pa.int64(), "bigint"), ("burst", pa.int64(), "bigint"),
    ("client_ready", pa.bool_(), "boolean"), ("closes", pa.bool_(), "boolean"),
    ("expires", pa.bool_(), "boolean"), ("low_iat", pa.int64(), "bigint"), ("low_span", pa.int64(), "bigint"),
    ("low_len", pa.int64(), "bigint"), ("burst_no", pa.int64(), "bigint"),
]


def _groups(batches: Iterable[pa.RecordBatch], names: Sequence[str]):
    """Each batch with the named columns as plain lists, read once."""
    for batch in batches:
        if batch.num_rows:
            yield batch, [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).tolist()
                          for n in names]


def ended(start: int, front: int) -> tuple:
    """Label of a row that carries no packet: the flow ended by timeout."""
    return (start, front, None, None, None, None, None, None, True, None, None, None, None)


def advance(track: Track, num: int, ts: int, side: int, symbol: int, size: int) -> list[tuple]:
    """Labels for one packet: none if it is dropped, and one more if it ends a silent flow."""
    before, begun, front = track.pairs, track.start, track.front
    outcome = track.step(num, ts, side, symbol, size)
    if outcome == DROPPED:
        return []
    closes = ready = False
    if outcome == ADDED:
        ready = CLIENT_READY[front][before[0]]
        if track.pairs[0] == BOTH_CLOSED:
            closes = True
            track.pairs = None
    minima = track.minima
    added = (track.start, track.front, track.gap, track.iat, track.span, track.burst, ready, closes, False,
             minima[side], minima[2], minima[3 + side], track.bursts)
    return [ended(begun, front), added] if outcome == EXPIRED else [added]


def label(timeout: int, idle: int):
    """Arrow function: rows of (key, chunk) groups in arrival order to accepted packets with their flow."""
    def run(batches):
        track = None
        for batch, (rank, num, ts, side, symbol, size) in _groups(
                batches, ["rank", "num", "ts_us", "side", "symbol", "len"]):
            entries = batch.column(batch.schema.get_field_index("entry"))
            rows, labels = [], []
            for i in range(batch.num_rows):
                if rank[i] == 1:
                    entry = entries[i].as_py()
                    if entry is not None:
                        track = Track.from_row(json.loads(entry), timeout, idle)
                        continue
                    track = Track(timeout, idle)
                for values in advance(track, num[i], ts[i], side[i], symbol[i], size[i]):
                    rows.append(i)
                    labels.append(values)
            if rows:
                kept = batch.take(pa.array(rows, pa.int32()))
                names = [n for n in kept.schema.names if n not in ("rank", "entry")]
                columns = [kept.column(n) for n in names]
                for (name, kind, _), values in zip(LABELS, zip(*labels)):
                    names.append(name)
                    columns.append(pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def summarise(key: Sequence[str], timeout: int, idle: int, schema: pa.Schema, head_limit: int = HEAD_LIMIT,
              rows_per_batch: int = 256):
    """Arrow function: rows of (key, chunk) groups to one summary row each."""
    def run(batches):
        summary, group, done = None, None, []
        for batch, (rank, num, ts, side, symbol, size) in _groups(
                batches, ["rank", "num", "ts_us", "side", "symbol", "len"]):
            peaks = batch.column(batch.schema.get_field_index("peak"))
            keys = [batch.column(batch.schema.get_field_index(n)) for n in [*key, "chunk"]]
            for i in range(batch.num_rows):
                if rank[i] == 1:
                    if summary is not None:
                        done.append({**group, **summary.to_row()})
                        if len(done) == rows_per_batch:
                            yield pa.RecordBatch.from_pylist(done, schema)
                            done = []
                    group = {n: k[i].as_py() for n, k in zip([*key, "chunk"], keys)}
                    peak = peaks[i].as_py()
                    summary = ChunkSummary(peak, timeout, idle, head_limit)
                    if peak is not None:
                        continue
                summary.add(num[i], ts[i], side[i], symbol[i], size[i])
        if summary is not None:
            done.append({**group, **summary.to_row()})
            yield pa.RecordBatch.from_pylist(done, schema)
    return run


def chain(key: Sequence[str], timeout: int, idle: int, schema: pa.Schema):
    """Arrow function: a key's summaries in chunk order to the state on entry of every chunk but the first.

    A row's ``leaves`` is its state on leaving after the entry ``taken``. At a chunk whose summary can't tell and that was
    not followed from this entry, ``stuck`` is set, and the chain goes on with a guess: what it left last time, or what
    it leaves if its first packet opens a flow. Up to a key's first such chunk the entries are certain.
    """
    def run(batches):
        group, track = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                this = [row[n] for n in key]
                first = this != group
                if first:
                    group, track = this, Track(timeout, idle)
                entry = json.dumps(track.to_row())
                after = None if row["taken"] == entry else apply_summary(track, row)
                stuck = after is None and row["taken"] != entry
                if after is None:
                    after = Track.from_row(json.loads(row["leaves"] or row["opened"]), timeout, idle)
                if not first or stuck:
                    out.append({**{n: row[n] for n in key}, "chunk": row["chunk"], "entry": entry, "stuck": stuck})
                track = after
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


def enter(key: Sequence[str], timeout: int, idle: int, schema: pa.Schema):
    """Arrow function: a key's rows after an entry row to the state on entry of that chunk and all later ones."""
    def run(batches):
        track = chunk = None
        for batch, (rank, num, ts, side, symbol, size, chunks) in _groups(
                batches, ["rank", "num", "ts_us", "side", "symbol", "len", "chunk"]):
            entries = batch.column(batch.schema.get_field_index("entry"))
            keys = [batch.column(batch.schema.get_field_index(n)) for n in key]
            out = []
            for i in range(batch.num_rows):
                if rank[i] == 1:
                    track, chunk = Track.from_row(json.loads(entries[i].as_py()), timeout, idle), None
                if chunks[i] != chunk:
                    chunk = chunks[i]
                    out.append({**{n: k[i].as_py() for n, k in zip(key, keys)}, "chunk": chunk,
                                "entry": json.dumps(track.to_row()), "stuck": False})
                if rank[i] != 1:
                    follow(track, num[i], ts[i], side[i], symbol[i], size[i])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


def go_through(key: Sequence[str], timeout: int, idle: int, schema: pa.Schema):
    """Arrow function: rows of (key, chunk) groups after their entry row to the state on leaving."""
    def run(batches):
        track, group, done = None, None, []

        def left() -> dict:
            return {**group, "leaves": json.dumps(track.to_row())}

        for batch, (rank, num, ts, side, symbol, size) in _groups(
                batches, ["rank", "num", "ts_us", "side", "symbol", "len"]):
            entries = batch.column(batch.schema.get_field_index("entry"))
            keys = [batch.column(batch.schema.get_field_index(n)) for n in [*key, "chunk"]]
            for i in range(batch.num_rows):
                if rank[i] == 1:
                    if track is not None:
                        done.append(left())
                    group = {n: k[i].as_py() for n, k in zip([*key, "chunk"], keys)} | {"taken": entries[i].as_py()}
                    track = Track.from_row(json.loads(entries[i].as_py()), timeout, idle)
                    continue
                follow(track, num[i], ts[i], side[i], symbol[i], size[i])
        if track is not None:
            done.append(left())
            yield pa.RecordBatch.from_pylist(done, schema)
    return run


def block_starts(width: int, place: Sequence[str]):
    """Arrow function: increasing timestamps of each block to its map from possible first starts to last starts.

    Possible first starts are those up to one width after the block's first timestamp, and the next one after.
    Chains that meet go on as one, so what is held is bounded by the timestamps within one width.
    """
    def run(batches):
        current, edge, names = None, None, None
        waiting: deque = deque()  # (current start, the first starts whose chains are there), ascending
        out: list[tuple] = []

        def flush() -> None:
            for start, firsts in waiting:
                out.extend((*current, first, start) for first in firsts)
            waiting.clear()

        for batch in batches:
            schema = batch.schema
            columns = [batch.column(schema.get_field_index(n)) for n in place]
            names = [schema.field(n) for n in place]
            keys = list(zip(*[c.to_pylist() for c in columns]))
            for key, ts in zip(keys, batch.column(schema.get_field_index("ts_us")).to_pylist()):
                if key != current:
                    flush()
                    current, edge, opened = key, ts + width, True
                moved = []
                while waiting and ts > waiting[0][0] + width:
                    moved += waiting.popleft()[1]
                if opened:  # the first timestamp beyond the edge is the last that may come first
                    moved.append(ts)
                    opened = ts <= edge
                if moved:
                    waiting.append((ts, moved))
            if out:
                yield _mapped(out, names)
                out = []
        flush()
        if out:
            yield _mapped(out, names)
    return run


def _mapped(rows: list[tuple], keys: list[pa.Field]) -> pa.RecordBatch:
    fields = [*keys, pa.field("first", pa.int64()), pa.field("last", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))


def anchor_starts(width: int, group: Sequence[str]):
    """Arrow function: increasing timestamps of each group to the window starts among them."""
    def run(batches):
        current, start = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in group]))
            times = batch.column(batch.schema.get_field_index("ts_us")).to_pylist()
            kept = []
            for i, (key, ts) in enumerate(zip(keys, times)):
                if key != current or ts > start + width:
                    current, start = key, ts
                    kept.append(i)
            if kept:
                yield batch.take(pa.array(kept, pa.int32()))
    return run


SPLIT = 24
_ZERO = ("span_n", "span_s", "span_q", "span_max", "span_low", "idle_n", "idle_s", "idle_q", "idle_max", "idle_low",
         *(f"{d}{v}_{p}" for d in "fb" for v in ("pktl", "iat") for p in ("n", "s", "qh", "ql", "max", "min")),
         *(n for d in "fb" for n in (f"total_{d}hlen", f"{d}psh_cnt", f"{d}urg_cnt")))


class FlowSums:
    """The sums of one flow, packet by packet: the row that ``sum_flows`` makes of all its packets."""

    def __init__(self, values: dict):
        self.values = values

    @classmethod
    def opened(cls, start: int, front: int) -> FlowSums:
        return cls(dict.fromkeys(_ZERO, 0) | {
            "flow_start": start, "front": front, "start_us": None, "last_us": None, "last_burst": None, "low_burst": None,
            "closed": False, "expired": False, "tcp_valid": False, "has_data": False, "first_dscp": None,
            "back_dscp": None})

    def _wide(self, name: str, value: int) -> None:
        v, first = self.values, not self.values[f"{name}_n"]
        v[f"{name}_n"] += 1
        v[f"{name}_s"] += value
        v[f"{name}_q"] += value * value
        v[f"{name}_max"] = max(v[f"{name}_max"], value)
        v[f"{name}_low"] = value if first else min(v[f"{name}_low"], value)

    def _value(self, name: str, value: int, low: int) -> None:
        v = self.values
        v[f"{name}_n"] += 1
        v[f"{name}_s"] += value
        v[f"{name}_qh"] += value * value >> SPLIT
        v[f"{name}_ql"] += value * value & (1 << SPLIT) - 1
        v[f"{name}_max"] = max(v[f"{name}_max"], value)
        v[f"{name}_min"] = low

    def add(self, packet: dict, label: tuple, idle: int, tcp: int, psh: int, urg: int) -> None:
        """One packet with its label, as ``advance`` gives it."""
        v = self.values
        start, front, gap, iat, span, burst, ready, closes, _, low_iat, low_span, low_len, _ = label
        ts, size, header = packet["ts_us"], packet["len"], packet["iphlen"] + packet["prhlen"]
        v["start_us"] = ts if v["start_us"] is None else min(v["start_us"], ts)
        v["last_us"] = ts if v["last_us"] is None else max(v["last_us"], ts)
        v["last_burst"] = burst if v["last_burst"] is None else max(v["last_burst"], burst)
        v["low_burst"] = low_span
        v["closed"] = v["closed"] or closes
        v["tcp_valid"] = v["tcp_valid"] or (ready and size > header)
        v["has_data"] = v["has_data"] or size > 8
        d = "f" if packet["side"] == front else "b"
        if packet["num"] == start:
            v["first_dscp"] = packet["dscp"]
        elif d == "b" and iat is None and packet["dscp"] and v["back_dscp"] is None:
            v["back_dscp"] = packet["dscp"]
        if span is not None:
            self._wide("span", span)
        if gap is not None and gap > idle:
            self._wide("idle", gap)
        self._value(f"{d}pktl", size, low_len)
        if iat is not None:
            self._value(f"{d}iat", iat, low_iat)
        v[f"total_{d}hlen"] += header
        if packet["proto"] == tcp:
            v[f"{d}psh_cnt"] += packet["flags"] & psh != 0
            v[f"{d}urg_cnt"] += packet["flags"] & urg != 0
