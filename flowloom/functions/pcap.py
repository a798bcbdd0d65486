"""Task-side reading of pcap containers, by stretches, through the file system Arrow finds for the path."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyarrow import fs

# Magic number of the file header to (byte order, ticks per second).
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
FILE_HEADER, RECORD_HEADER = 24, 16
BLOCK = 1 << 22
STRETCH = 1 << 26
BATCH = 5000
CHAIN, LONGEST, GUESS = 8, 262_144, 1 << 24


def open_capture(path: str):
    uri = "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


def layout(handle) -> tuple[str, int]:
    handle.seek(0)
    magic = handle.read(FILE_HEADER)[:4]
    if magic not in MAGICS:
        raise ValueError("not a pcap file")
    return MAGICS[magic]


def records(handle, order: str, offset: int, stop: int):
    """(offset, seconds, fraction, bytes) of each whole record that begins in [offset, stop)."""
    head = struct.Struct(order + "IIII")
    handle.seek(offset)
    held, at = b"", 0
    while offset < stop:
        while len(held) - at < RECORD_HEADER:
            more = handle.read(BLOCK)
            if not more:
                return
            held, at = held[at:] + more, 0
        seconds, fraction, size, _ = head.unpack_from(held, at)
        end = at + RECORD_HEADER + size
        while len(held) < end:
            more = handle.read(max(BLOCK, end - len(held)))
            if not more:
                return  # a capture cut off mid-record
            held, at, end = held[at:] + more, 0, end - at
        yield offset, seconds, fraction, held[at + RECORD_HEADER:end]
        offset += end - at
        at = end


def hop(handle, order: str, offset: int, stop: int, length: int) -> tuple[int, int, bool]:
    """From a record at ``offset``: how many records begin before ``stop``, where the next one begins, and whether
    the file ends within one."""
    head = struct.Struct(order + "IIII")
    count, held, base = 0, b"", offset
    while offset < stop:
        if offset + RECORD_HEADER > length:
            return count, offset, True
        if not base <= offset <= base + len(held) - RECORD_HEADER:
            handle.seek(offset)
            held, base = handle.read(min(BLOCK, length - offset)), offset
        size = head.unpack_from(held, offset - base)[2]
        if offset + RECORD_HEADER + size > length:
            return count, offset, True
        offset += RECORD_HEADER + size
        count += 1
    return count, offset, False


def plausible_start(handle, order: str, ticks: int, begin: int, stop: int, length: int) -> int:
    """The first offset from ``begin`` on where ``CHAIN`` record headers in a row make sense; -1 if there is none.

    A guess: ``number_stretches`` uses it only where the records before lead to the same offset.
    """
    handle.seek(16)
    longest = struct.unpack(order + "I", handle.read(4))[0] or LONGEST
    head = struct.Struct(order + "IIII")
    handle.seek(begin)
    window = handle.read(min(stop - begin + CHAIN * (longest + RECORD_HEADER), GUESS, length - begin))
    for start in range(min(stop - begin, len(window))):
        at, seen = start, 0
        while seen < CHAIN and at + RECORD_HEADER <= len(window):
            _, fraction, size, full = head.unpack_from(window, at)
            if fraction >= ticks or not 0 < size <= min(longest, full):
                break
            at += RECORD_HEADER + size
            seen += 1
        else:
            if seen == CHAIN or begin + at == length:
                return begin + start
    return -1


def probe_stretches(batches):
    """Stretches of fixed length to the record they seem to begin with, and what follows from it."""
    for batch in batches:
        out = []
        for path, length, part, span in zip(*(batch.column(i).to_pylist() for i in range(4))):
            begin, stop = part * span, min(length, (part + 1) * span)
            with open_capture(path) as handle:
                order, ticks = layout(handle)
                guess = FILE_HEADER if part == 0 else plausible_start(handle, order, ticks, begin, stop, length)
                count, after, cut = (0, -1, False) if guess < 0 else hop(handle, order, guess, stop, length)
            out.append((path, length, part, stop, guess, count, after, cut))
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["path", "length", "part", "stop", "guess", "count", "after", "cut"])


def number_stretches(batches):
    """A file's probed stretches in order to stretches with their true first record and its number.

    Where the records before lead elsewhere than the guess, the stretch is followed from there.  ``cut_at`` is
    where a capture that ends within a record leaves off.
    """
    current, expected, number = None, 0, 1
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["path"] != current:
                current, expected, number = row["path"], FILE_HEADER, 1
            if expected is None or expected >= row["stop"]:
                continue
            count, after, cut = row["count"], row["after"], row["cut"]
            if row["guess"] != expected:
                with open_capture(current) as handle:
                    count, after, cut = hop(handle, layout(handle)[0], expected, row["stop"], row["length"])
            out.append((current, expected, row["stop"], number, after if cut else None, count))
            expected, number = None if cut else after, number + count
        if out:
            kinds = [pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["path", "begin", "stop", "first", "cut_at", "records"])


def read_stretches(batches):
    """Stretches to frames."""
    for batch in batches:
        for path, begin, stop, number in zip(*(batch.column(i).to_pylist() for i in range(4))):
            with open_capture(path) as handle:
                order, ticks = layout(handle)
                rows = []
                for _, seconds, fraction, data in records(handle, order, begin, stop):
                    rows.append((path, number, seconds + fraction / ticks, data))
                    number += 1
                    if len(rows) == BATCH:
                        yield _frames(rows)
                        rows = []
                if rows:
                    yield _frames(rows)


def _frames(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)],
                                      ["capture", "num", "ts", "frame"])
