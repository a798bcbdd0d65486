"""The sequential part of flow metering: which flow does each packet of a key belong to?

Whether a TCP packet closes its flow depends on the state left by the packets before it, and where the
next flow starts depends on where the last one closed, so this cannot be a window function.  A ``Track``
holds that state for one canonical key and advances by one packet in constant memory.

The two endpoints of a connection are numbered 0 (lower address) and 1.  Each runs its own small machine
over the packets of both sides, and the pair of machine states is one byte.  Advancing the pair is a byte
translation, so one ``Track`` can carry *several* alternative pairs at once: this is how a chunk of a hot
key is summarised before the state on entry is known (see ``ChunkSummary``).
"""

from __future__ import annotations

import copy
import json

# TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32

# Machine states of one endpoint.
START, SYN_SENT, SYN_ACKED, ESTABLISHED, FINISHING, CLOSED = range(6)
BOTH_CLOSED = CLOSED * 6 + CLOSED
UDP_SYMBOL = 128

OPENED, EXPIRED, ADDED, DROPPED = range(4)
INHERIT = -2
N_MINIMA = 5  # gap side 0, gap side 1, burst span, length side 0, length side 1


def _has(flags: int, bits: int) -> bool:
    return flags & bits == bits


def endpoint_next(state: int, flags: int, own: bool) -> int:
    """Next state of one endpoint's machine; ``own`` means this endpoint sent the packet."""
    if _has(flags, RST):
        return CLOSED
    if own:
        if _has(flags, FIN):
            return FINISHING
        return {START: SYN_SENT if _has(flags, SYN) else START,
                SYN_ACKED: ESTABLISHED if _has(flags, ACK) else SYN_ACKED}.get(state, state)
    return {SYN_SENT: SYN_ACKED if _has(flags, SYN | ACK) else SYN_SENT,
            FINISHING: CLOSED if _has(flags, ACK) else FINISHING}.get(state, state)


def _pair_table(side: int, flags: int) -> bytes:
    table = bytearray(range(256))
    for pair in range(36):
        low, high = divmod(pair, 6)
        table[pair] = endpoint_next(low, flags, side == 0) * 6 + endpoint_next(high, flags, side == 1)
    return bytes(table)


# symbol = 64 * side + flags for TCP, UDP_SYMBOL otherwise
PAIR_TABLES = [_pair_table(s, f) for s in (0, 1) for f in range(64)] + [bytes(range(256))]
OPENING = [table[0:1] for table in PAIR_TABLES]
# is the machine of the side that opened the flow established?
CLIENT_READY = [
    [divmod(pair, 6)[front] == ESTABLISHED for pair in range(36)] + [False] * 220 for front in (0, 1)
]


class Track:
    """State of the current flow of one key.  ``pairs is None``: the next packet opens a flow.

    The minima treat zero as "not set": after a zero the next value replaces it, whatever its size.
    """

    __slots__ = ("timeout", "idle", "pairs", "last", "start", "front", "seen", "burst", "bursts", "minima",
                 "wiped", "early", "early_end", "gap", "iat", "span")

    def __init__(self, timeout: int, idle: int):
        self.timeout = timeout
        self.idle = idle
        self.pairs = None
        self.start = None
        self.last = self.front = self.burst = 0
        self.bursts = 0  # bursts of the flow that ended so far
        self.seen = [None, None]
        self.minima = [0] * N_MINIMA
        self.wiped = 0
        self.early = [None, None]
        self.early_end = None
        self.gap = self.iat = self.span = None

    def step(self, num: int, ts: int, side: int, symbol: int, size: int) -> int:
        pairs = self.pairs
        if pairs is None:
            return self._open(num, ts, side, symbol, size, OPENED)
        gap = ts - self.last
        if gap > self.timeout:
            return self._open(num, ts, side, symbol, size, EXPIRED)
        if gap < 0:
            return DROPPED
        minima = self.minima
        seen = self.seen
        self.span = self.iat = None
        if gap > self.idle:
            if self.burst == INHERIT:
                self.early_end = self.last
            else:
                self.span = self._lower(2, self.last - self.burst)
            seen[0] = seen[1] = None
            self.burst = ts
            self.bursts += 1
        else:
            previous = seen[side]
            if previous is not None:
                if previous == INHERIT:
                    self.early[side] = ts
                else:
                    self.iat = iat = ts - previous
                    held = minima[side]
                    if held == 0 or iat < held:
                        minima[side] = iat
                    if iat == 0:
                        self.wiped |= 1 << side
        seen[side] = ts
        held = minima[3 + side]
        if held == 0 or size < held:
            minima[3 + side] = size
            if size == 0:
                self.wiped |= 8 << side
        self.gap = gap
        self.last = ts
        self.pairs = pairs.translate(PAIR_TABLES[symbol])
        return ADDED

    def _lower(self, kind: int, value: int) -> int:
        held = self.minima[kind]
        if held == 0 or value < held:
            self.minima[kind] = value
        if value == 0:
            self.wiped |= 1 << kind
        return value

    def _open(self, num, ts, side, symbol, size, outcome) -> int:
        self.pairs = OPENING[symbol]
        self.start = num
        self.front = side
        self.last = self.burst = ts
        self.bursts = 0
        self.seen = [None, None]
        self.seen[side] = ts
        self.minima = [0] * N_MINIMA
        self.minima[3 + side] = size
        self.gap = self.iat = self.span = None
        return outcome

    # -- carrying state from one chunk of a hot key to the next

    def to_row(self) -> dict:
        """The state as plain values; ``pair`` is -1 when the next packet opens a flow."""
        return {
            "pair": -1 if self.pairs is None else self.pairs[0],
            "last": self.last, "start": self.start, "front": self.front,
            "seen": list(self.seen), "burst": self.burst, "bursts": self.bursts, "minima": list(self.minima),
        }

    @classmethod
    def from_row(cls, row: dict, timeout: int, idle: int) -> Track:
        track = cls(timeout, idle)
        track.pairs = None if row["pair"] < 0 else bytes([row["pair"]])
        track.last, track.start, track.front, track.burst, track.bursts = (
            row["last"], row["start"], row["front"], row["burst"], row["bursts"])
        track.seen = list(row["seen"])
        track.minima = list(row["minima"])
        return track


FRESH_LANE = 36


HEAD_LIMIT = 4096


def follow(track: Track, num: int, ts: int, side: int, symbol: int, size: int) -> None:
    """One packet, and the close that it may bring."""
    if track.step(num, ts, side, symbol, size) == ADDED and track.pairs[0] == BOTH_CLOSED:
        track.pairs = None


class ChunkSummary:
    """What one chunk does to every state a key may enter it with.

    ``peak`` is the largest timestamp of the key in earlier chunks.  The first packet at or above it is
    accepted whatever the state is, and leaves ``last`` at its own timestamp, so from there on only the
    37 lanes (36 machine pairs, or "next packet opens") matter.  Packets up to and including that one are
    kept as the ``head`` and are replayed when chunks are put together.

    A head longer than ``limit`` (a clock that jumped ahead) is not kept.  Two entries still have a known
    result: a key whose next packet opens a flow is followed packet by packet (``opened``), and one whose last
    packet is later than all of the head (``head_top``) drops it up to the packet that ended it.  A key that
    enters between these must go through the chunk itself; ``apply_summary`` says so.
    """

    def __init__(self, peak: int | None, timeout: int, idle: int, limit: int = HEAD_LIMIT):
        self.peak = peak
        self.timeout = timeout
        self.idle = idle
        self.limit = limit
        self.head: list[tuple] = []
        self.head_top: int | None = None
        self.opened: Track | None = None
        self.tracks: list[tuple[Track, list[list[int]]]] | None = None
        self.fresh: list[int] = []

    def add(self, num: int, ts: int, side: int, symbol: int, size: int) -> None:
        if self.opened is not None:
            follow(self.opened, num, ts, side, symbol, size)
        if self.tracks is None:
            ends = self.peak is None or ts >= self.peak
            if self.opened is None:
                self.head.append((num, ts, side, symbol, size))
                if len(self.head) > self.limit:
                    self.opened = Track(self.timeout, self.idle)
                    for packet in self.head:
                        follow(self.opened, *packet)
                    self.head = []
            if ends:
                if self.opened is not None:
                    self.head = [(num, ts, side, symbol, size)]
                self._start(ts)
            else:
                self.head_top = ts if self.head_top is None else max(self.head_top, ts)
            return
        opening, self.fresh = self.fresh, []
        for position in range(len(self.tracks) - 1, -1, -1):
            track, lanes = self.tracks[position]
            outcome = track.step(num, ts, side, symbol, size)
            if outcome == EXPIRED:
                self.tracks[position] = (track, [[lane for group in lanes for lane in group]])
            elif outcome == ADDED and BOTH_CLOSED in track.pairs:
                self._close(position)
        if opening:
            track = Track(self.timeout, self.idle)
            track.step(num, ts, side, symbol, size)
            self.tracks.append((track, [opening]))

    def _start(self, ts: int) -> None:
        track = Track(self.timeout, self.idle)
        track.pairs = bytes(range(36))
        track.last = ts
        track.start = INHERIT
        track.front = track.burst = INHERIT
        track.seen = [INHERIT, INHERIT]
        self.tracks = [(track, [[lane] for lane in range(36)])]
        self.fresh = [FRESH_LANE]

    def _close(self, position: int) -> None:
        track, lanes = self.tracks[position]
        left = []
        for pair, group in zip(track.pairs, lanes):
            if pair == BOTH_CLOSED:
                self.fresh.extend(group)
            else:
                left.append((pair, group))
        if left:
            track.pairs = bytes(pair for pair, _ in left)
            self.tracks[position] = (track, [group for _, group in left])
        else:
            del self.tracks[position]

    def to_row(self) -> dict:
        """Plain values: the head's columns, and per lane the track it is in and its machine pair."""
        lane_track = [-1] * (FRESH_LANE + 1)
        lane_pair = [-1] * (FRESH_LANE + 1)
        states = []
        for index, (track, lanes) in enumerate(self.tracks or []):
            for pair, group in zip(track.pairs, lanes):
                for lane in group:
                    lane_track[lane], lane_pair[lane] = index, pair
            states.append([track.last, track.start, track.front, *track.seen, track.burst, track.bursts,
                           *track.early, track.early_end, track.wiped, *track.minima])
        return {
            "head": [value for packet in self.head for value in packet],
            "head_top": self.head_top,
            "opened": None if self.opened is None else json.dumps(self.opened.to_row()),
            "synced": self.tracks is not None,
            "lane_track": lane_track, "lane_pair": lane_pair, "states": states,
        }


def apply_summary(track: Track, row: dict) -> Track | None:
    """State after a chunk, from the state before it and the chunk's ``ChunkSummary.to_row()``.

    None if the summary can't tell, so that this state must go through the chunk's packets.
    """
    if row["opened"] is not None:
        if track.pairs is None:
            return Track.from_row(json.loads(row["opened"]), track.timeout, track.idle)
        if row["head_top"] is not None and track.last <= row["head_top"]:
            return None
    head = row["head"]
    for at in range(0, len(head), 5):
        follow(track, *(int(v) for v in head[at:at + 5]))
    if not row["synced"]:
        return track
    lane = FRESH_LANE if track.pairs is None else track.pairs[0]
    index = row["lane_track"][lane]
    after = copy.copy(track)
    if index < 0:
        after.pairs = None
        return after
    (last, start, front, seen0, seen1, burst, bursts, early0, early1, early_end, wiped,
     *minima) = row["states"][index]
    after.pairs = bytes([row["lane_pair"][lane]])
    after.last = last
    if start != INHERIT:
        after.start, after.front, after.seen, after.burst = start, front, [seen0, seen1], burst
        after.bursts, after.minima = bursts, minima
        return after
    after.bursts = track.bursts + bursts
    first = [None if early is None or track.seen[side] is None else early - track.seen[side]
             for side, early in enumerate((early0, early1))]
    first += [None if early_end is None else early_end - track.burst, None, None]
    merged = list(track.minima)
    for kind in range(N_MINIMA):
        if first[kind] is not None and (merged[kind] == 0 or first[kind] < merged[kind]):
            merged[kind] = first[kind]
        value = minima[kind]
        if wiped >> kind & 1 or (value and (merged[kind] == 0 or value < merged[kind])):
            merged[kind] = value
    after.minima = merged
    after.seen = [track.seen[side] if value == INHERIT else value for side, value in enumerate((seen0, seen1))]
    after.burst = track.burst if burst == INHERIT else burst
    return after
