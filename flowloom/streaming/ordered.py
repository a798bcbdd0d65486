"""Stateful processors that meter the packets of a key in the order of their numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from flowloom.functions import folds, tracking
from flowloom.functions.waiting import due_ms, released
from flowloom.operators.packets import FLAG_BITS, TCP

#: How far a capture's clock may run back between two packets, and the slices of packet time in which packets wait (µs).
SKEW, WIDTH = 2_000_000, 2_000_000
#: Packets in one entry of the state, and rows handed on at once.
BLOCK, ROWS = 4096, 8192


def whole_numbers(schema: T.StructType) -> dict[str, str]:
    """Pandas kinds that keep whole numbers and booleans beside NULLs."""
    kinds = {f.name: "Int64" for f in schema
             if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))}
    return kinds | {f.name: "boolean" for f in schema if isinstance(f.dataType, T.BooleanType)}


class OrderedMeter(StatefulProcessor):
    """Holds the packets of a key until their turn comes; ``Segmenter`` and ``FlowSummer`` say what becomes of them.

    State of a key: the machine of its current flow as JSON, and the waiting packets in blocks of neighbours in packet time,
    with the slices that each block has packets of. One timer at a time wakes the key, when the watermark has passed its
    first waiting slice; it then goes through all slices that the watermark has passed.
    """

    def __init__(self, key: Sequence[str], packet: T.StructType, out: T.StructType, timeout: int, idle: int, skew: int,
                 width: int):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.key_names, self.names = list(key), packet.names
        self.arrow = to_arrow_schema(T.StructType([f for f in packet if f.name not in key]))
        self.columns, self.kinds = [*out.names, "late"], whole_numbers(out)
        self.wide = [f.name for f in out if isinstance(f.dataType, T.DecimalType)]
        self.timeout, self.idle, self.skew, self.width = timeout, idle, skew, width

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string")
        self.chunks = handle.getMapState("chunks", "block long", "packets binary")

    def close(self) -> None:
        pass

    # -- state

    def _load(self) -> dict:
        held = self.held.get() if self.held.exists() else None
        return json.loads(held[0]) if held else {
            "track": None, "flow": None, "blocks": {}, "next": 0, "due": None, "wake": None}

    def _keep(self, state: dict, packets: pa.RecordBatch) -> None:
        """Store packets that are in order of time."""
        times = packets.column(packets.schema.get_field_index("ts_us")).to_numpy()
        for at in range(0, packets.num_rows, BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.arrow) as writer:
                writer.write_batch(packets.slice(at, BLOCK))
            self.chunks.updateValue((state["next"],), (sink.getvalue().to_pybytes(),))
            state["blocks"][str(state["next"])] = np.unique(times[at:at + BLOCK] // self.width).tolist()
            state["next"] += 1

    def _taker(self, blocks: dict, loaded: dict[int, list[dict]]):
        """Hands out the packets of a slice; other slices of the blocks that it takes from the state wait in ``loaded``."""
        having: dict[int, list[str]] = {}
        for block, slices in blocks.items():
            for number in slices:
                having.setdefault(number, []).append(block)

        def take(number: int) -> list[dict]:
            for block in having.get(number, []):
                if blocks.pop(block, None) is not None:
                    for packet in pa.ipc.open_stream(self.chunks.getValue((int(block),))[0]).read_all().to_pylist():
                        loaded.setdefault(packet["ts_us"] // self.width, []).append(packet)
                    self.chunks.removeKey((int(block),))
            return loaded.pop(number, [])

        return take

    def _wait(self, state: dict) -> None:
        """Set the timer for the first waiting slice."""
        first = min((slices[0] for slices in state["blocks"].values()), default=None)
        due = None if first is None else due_ms(first, self.width, self.skew)
        if due != state["due"]:
            if due is not None:
                self.handle.registerTimer(due)
            state["due"] = due

    # -- calls

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, mark = self._load(), timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            late = frame["ts_us"] // 1000 < mark
            if late.any():
                lost = frame[late][self.names]
                made = pd.DataFrame(dict.fromkeys(self.columns, [None] * len(lost)), dtype=object)
                for name, value in zip(self.key_names, key, strict=True):
                    if name in made:
                        made[name] = value
                made["late"] = lost.to_json(orient="records", lines=True).splitlines()
                yield made[self.columns].astype(self.kinds)
                frame = frame[~late]
            self._keep(state, pa.RecordBatch.from_pandas(
                frame.sort_values("ts_us")[self.arrow.names], schema=self.arrow, preserve_index=False))
        self._wait(state)
        self.held.update((json.dumps(state),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        state, mark = self._load(), timerValues.getCurrentWatermarkInMs()
        named, blocks = dict(zip(self.key_names, key, strict=True)), state["blocks"]
        track = (tracking.Track(self.timeout, self.idle) if state["track"] is None
                 else tracking.Track.from_row(state["track"], self.timeout, self.idle))
        self.open(state["flow"])
        waiting = sorted({number for slices in blocks.values() for number in slices})
        ready = {n for n in waiting if due_ms(n, self.width, self.skew) <= mark}
        loaded: dict[int, list[dict]] = {}
        left: dict[int, list[dict]] = {}
        for packets, left in released(waiting, ready, self._taker(blocks, loaded), self.width):
            for packet in packets:
                packet.update(named)
                for label in folds.advance(track, packet["num"], packet["ts_us"], packet["side"], packet["symbol"], packet["len"]):
                    self.packet(packet, label)
            if len(self.rows) >= ROWS:
                yield from self.done(named)
        back = sorted((p for packets in (*left.values(), *loaded.values()) for p in packets), key=lambda p: p["ts_us"])
        if back:
            self._keep(state, pa.RecordBatch.from_pylist(back, self.arrow))
        self._wait(state)
        if track.pairs is not None and self._silent_ms(track) < mark:
            self.packet(None, folds.ended(track.start, track.front))
            track.pairs = None
        yield from self.done(named)
        if track.pairs is None and not blocks:
            self.held.clear()
            return
        wake = None if track.pairs is None else self._silent_ms(track) + 1
        if wake is not None and wake != state["wake"]:
            self.handle.registerTimer(max(wake, mark + 1))
        self.held.update((json.dumps(state | {"track": track.to_row(), "flow": self.flow(), "wake": wake}),))

    def _silent_ms(self, track) -> int:
        """Watermark after which silence has ended the flow."""
        return track.last // 1000 + self.timeout // 1000 + 1

    # -- what becomes of packets

    def open(self, flow) -> None:
        self.rows: list = []

    def flow(self):
        return None

    def packet(self, packet: dict | None, label: tuple) -> None:
        raise NotImplementedError

    def done(self, named: dict) -> Iterator[pd.DataFrame]:
        if self.rows:
            rows = [[row.get(c) for c in self.columns] for row in self.rows]
            yield pd.DataFrame(rows, columns=self.columns, dtype=object).astype(self.kinds)
            self.rows = []


class Segmenter(OrderedMeter):
    """Packets with the flow they belong to, as they are labelled."""

    def packet(self, packet, label) -> None:
        self.rows.append((packet or {}, label))

    def done(self, named) -> Iterator[pd.DataFrame]:
        names = [n for n, _, _ in folds.LABELS]
        self.rows = [named | packet | dict(zip(names, label, strict=True)) for packet, label in self.rows]
        yield from super().done(named)


class FlowSummer(OrderedMeter):
    """The sums of each flow when it ends."""

    def open(self, flow) -> None:
        super().open(flow)
        self.sums = None if flow is None else folds.FlowSums(flow)

    def flow(self):
        return None if self.sums is None else self.sums.values

    def packet(self, packet, label) -> None:
        if label[8]:
            self.sums.values["expired"] = True
        else:
            if self.sums is None:
                self.sums = folds.FlowSums.opened(label[0], label[1])
            self.sums.add(packet, label, self.idle, TCP, FLAG_BITS["psh"], FLAG_BITS["urg"])
        if label[7] or label[8]:
            self.rows.append(self.sums.values)
            self.sums = None

    def done(self, named) -> Iterator[pd.DataFrame]:
        self.rows = [named | values | {n: Decimal(values[n]) for n in self.wide} for values in self.rows]
        yield from super().done(named)
