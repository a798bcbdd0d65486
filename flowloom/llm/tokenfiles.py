"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the low chunk of every id, level 1 the next chunk of the ids
that have more, and so on; a bitmap at each level tells which ids go on, and a rank directory holds the number of ones
before every 512 bits. Any id is read by following its rank from level to level, without decoding what stands before it.
A file holds whole documents, in ascending doc_id order, about ``SEGMENT_IDS`` ids; files are numbered in that order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

MAGIC = b"FLDAC001"
HEADER = struct.Struct(">8sqqqqq")  # magic, part, number in part, ids, documents, levels
SEGMENT_IDS = 4 << 20
CHUNK_BITS = 8
RANK_BITS = 512
KNOWN_CHUNKS = 800_000
KNOWN_WORDS = 500_000
FLUSH_BYTES = 8 << 20
#: A pre-token as the word-level tokenizer file splits it, for chunks that its normalizer only brings to lower case.
_SIMPLE = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Level:
    """One level: its chunks, which of them go on, and the ranks of those."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    def goes_on(self, i: int) -> bool:
        return bool(self.bitmap[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """How many of the first ``i`` chunks go on."""
        block = i // RANK_BITS
        start = block * RANK_BITS // 8
        part = int.from_bytes(self.bitmap[start:(i + 7) // 8].tobytes(), "little") & ((1 << (i - block * RANK_BITS)) - 1)
        return int(self.ranks[block]) + part.bit_count()


class Codes:
    """A sequence of ids as directly addressable codes."""

    def __init__(self, levels: list[Level], size: int):
        self.levels, self.size = levels, size

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, left = [], np.asarray(ids, dtype=np.uint32)
        size = len(left)
        while len(left) or not levels:
            more = left >> CHUNK_BITS != 0
            bitmap = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-len(left) // RANK_BITS) + 1, dtype=np.int64)
            if len(left):
                padded[1:] = np.add.reduceat(more.astype(np.int64), np.arange(0, len(left), RANK_BITS))
            levels.append(Level(left.astype(np.uint8), bitmap, np.cumsum(padded).astype("<u4")))
            left = left[more] >> CHUNK_BITS
        return cls(levels, size)

    def get(self, i: int) -> int:
        """The ``i``-th id."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for shift, level in enumerate(self.levels):
            value |= int(level.chunks[i]) << (CHUNK_BITS * shift)
            if not level.goes_on(i):
                break
            i = level.rank(i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, reading only their own chunks at each level."""
        parts, start, stop = [], int(start), int(stop)
        for level in self.levels:
            first = start >> 3
            more = np.unpackbits(level.bitmap[first:(stop + 7) >> 3], bitorder="little")[start - 8 * first:stop - 8 * first]
            parts.append((level.chunks[start:stop], more.astype(bool)))
            if not more.any():
                break
            start, stop = level.rank(start), level.rank(stop)
        value = np.zeros(0, dtype=np.uint32)
        for chunks, more in reversed(parts):
            whole = chunks.astype(np.uint32)
            if value.size:
                whole[more] |= value << np.uint32(CHUNK_BITS)
            value = whole
        return value

    def to_bytes(self) -> bytes:
        out = []
        for level in self.levels:
            out += [struct.pack(">q", len(level.chunks)), level.chunks.tobytes(), level.bitmap.tobytes(),
                    level.ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: memoryview, levels: int, size: int) -> Codes:
        at, out = 0, []
        for _ in range(levels):
            count = struct.unpack_from(">q", data, at)[0]
            at += 8
            arrays = []
            for length, kind in ((count, np.uint8), (-(-count // 8), np.uint8), (-(-count // RANK_BITS) + 1, "<u4")):
                array = np.frombuffer(data, dtype=kind, count=length, offset=at)
                arrays.append(array)
                at += array.nbytes
            out.append(Level(*arrays))
        return cls(out, size)


class _Words(dict):
    """Ids of single pre-tokens, from the library's model."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.model = tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(map(self.byte_chars.__getitem__, word.encode()))
        packed = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = packed
        return packed


class Encoder(dict):
    """The library's tokenizer, remembering the ids of chunks between white space.

    No step of the tokenizer looks past white space: its rules are checked here to be those known to behave so, and
    other rules are refused. Chunks of plain Western letters are split here, and only words not seen lately are given
    to the library's model; every other chunk is encoded by the library as it is.
    """

    def __init__(self, tokenizer: bytes):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer.decode())
        import json
        rules = json.loads(tokenizer)
        kinds = [n["type"] for n in rules["normalizer"]["normalizers"]]
        steps = rules["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] \
                or steps[0]["pattern"]["Regex"] != _SPLIT or any(
                    t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] or "<|" not in t["content"]
                    for t in rules["added_tokens"]):
            raise ValueError("not a word-level tokenizer file of the supported kind")
        self.words = _Words(self.tokenizer)

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if "<|" not in text and _SIMPLE.fullmatch(text):
            packed = b"".join(map(self.words.__getitem__, _WORDS.findall(text.lower())))
        else:
            packed = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) >= KNOWN_CHUNKS:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


@lru_cache(2)
def load(tokenizer: bytes) -> Encoder:
    return Encoder(tokenizer)


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _segment(part: int, number: int, keys: list[int | None], lengths: list[int], packed: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(packed), dtype="<u4")
    codes = Codes.of(ids)
    return HEADER.pack(MAGIC, part, number, len(ids), len(keys), len(codes.levels)) + np.array(
        [k is not None for k in keys], dtype=np.uint8).tobytes() + np.array(
        [k or 0 for k in keys], dtype="<i8").tobytes() + np.array(lengths, dtype="<i8").tobytes() + codes.to_bytes()


def write_tokens(documents: DataFrame, path: str, tokenizer: bytes, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``documents`` (doc_id, text) in ascending doc_id order into files below ``path``.

    NULL text is empty; each document ends with ``end_id``. Rows without doc_id come first, rows that share one follow
    each other by their text. Texts are dealt to tasks by ranges of doc_id, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = load(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        keys, lengths, packed, held = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                keys.append(key.as_py())
                lengths.append(len(ids) // 4)
                packed.append(ids)
                held += lengths[-1]
                if held >= segment_ids:
                    yield pa.record_batch([pa.array([_segment(part, number, keys, lengths, packed)], pa.binary())], ["s"])
                    keys, lengths, packed, held, number = [], [], [], 0, number + 1
        if keys:
            yield pa.record_batch([pa.array([_segment(part, number, keys, lengths, packed)], pa.binary())], ["s"])

    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # a row is a file; the text writer puts its bytes there as they are, and a line feed after them
    ordered.mapInArrow(run, "s binary").select(F.col("s").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)


def _open(content: memoryview) -> tuple[Codes, np.ndarray, np.ndarray, np.ndarray]:
    magic, _, _, size, documents, levels = HEADER.unpack_from(content, 0)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    there = np.frombuffer(content, np.uint8, documents, at)
    keys = np.frombuffer(content, "<i8", documents, at + documents)
    lengths = np.frombuffer(content, "<i8", documents, at + 9 * documents)
    return Codes.from_bytes(content[at + 17 * documents:], levels, size), there, keys, lengths


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "number", "doc_id", "offset", "ids"]
    for batch in batches:
        for part, number, content in zip(*(batch.column(i) for i in range(3)), strict=True):
            codes, there, keys, lengths = _open(memoryview(content.as_buffer()))
            ends = np.cumsum(lengths)
            first = 0
            while first < len(keys):  # so many documents at once that their ids are bounded
                begin = int(ends[first] - lengths[first])
                last = max(first + 1, int(np.searchsorted(ends, begin + FLUSH_BYTES // 4, "right")))
                flat = codes.slice(begin, int(ends[last - 1])).astype("<u4").tobytes()
                ids = [flat[4 * int(ends[i] - lengths[i] - begin):4 * int(ends[i] - begin)] for i in range(first, last)]
                count = last - first
                yield pa.record_batch([
                    pa.array([part.as_py()] * count, pa.int64()), pa.array([number.as_py()] * count, pa.int64()),
                    pa.array(keys[first:last], pa.int64(), mask=there[first:last] == 0),
                    pa.array((ends - lengths)[first:last], pa.int64()), pa.array(ids, pa.binary())], names)
                first = last


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files below ``path``: part, number, doc_id, offset (in its file), ids.

    ``ids`` are little-endian 32-bit numbers. A file is read whole; its size is bounded by ``segment_ids`` and the
    largest document.
    """
    return _files(spark, path).select("part", "number", "content").mapInArrow(
        _read, "part long, number long, doc_id long, offset long, ids binary")


def _files(spark: SparkSession, path: str) -> DataFrame:
    def field(i: int):
        return F.conv(F.hex(F.substring("content", 9 + 8 * i, 8)), 16, 10).cast("long")

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return raw.where("length >= 48").select(field(0).alias("part"), field(1).alias("number"), field(2).alias("size"), "content")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """How many ids stand in the files before each: part, number, start. One row per file meets in the window."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return _files(spark, path).select("part", "number", "size").withColumn(
        "start", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))).drop("size")
