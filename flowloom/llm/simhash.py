"""SimHash near-duplicates through BK-trees.

A fingerprint bit is the majority of that bit over the hashes of a document's three-word shingles. Codes within three
bits of each other agree in one of any four parts, so distinct fingerprints are sharded by (part, value): whatever is
linked meets in a shard. Each shard is a BK-tree (children keyed by their Hamming distance to the parent); a search
follows only edges within the radius. The set of fingerprints grows with the corpus, so trees are built where the
shards are shuffled to and not broadcast. A shard above ``SHARD_ROWS`` codes is split again, by four parts of the bits
that its codes needn't share, which loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from flowloom.llm.common import components, word_blocks

RADIUS = 3
SEED = 42
SHINGLE = 3
SHARD_ROWS = 1000
LEVELS = (64, 48, 36)
CHUNK = 1 << 16


def simhash(text: str | None) -> int:
    """The fingerprint of a text as a signed 64-bit number; 0 if it has no words."""
    if not text:
        return 0
    counts, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for block in word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + block
        for start in range(0, len(words) - SHINGLE + 1, CHUNK):
            part = words[start:start + CHUNK + SHINGLE - 1]
            hashes = map(xxh64_intdigest, map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False)), repeat(SEED))
            bits = np.fromiter(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
            total += len(bits)
        tail = words[-(SHINGLE - 1):]
    if not total:
        return _signed(xxh64_intdigest(b" ".join(tail), SEED)) if tail else 0
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in text], dtype="int64")


class Tree:
    """A BK-tree that tells, for each code added, which codes within the radius were there before."""

    def __init__(self, radius: int):
        self.radius, self.codes, self.children = radius, [], []

    def add(self, code: int) -> list[int]:
        codes, children, radius = self.codes, self.children, self.radius
        place = len(codes)
        codes.append(code)
        children.append({})
        if not place:
            return []
        near, todo = [], [0]
        while todo:
            at = todo.pop()
            distance = (codes[at] ^ code).bit_count()
            if distance <= radius:
                near.append(at)
            edges = children[at]
            if len(edges) <= 2 * radius + 1:
                todo += [child for d, child in edges.items() if -radius <= d - distance <= radius]
            else:
                todo += [edges[d] for d in range(distance - radius, distance + radius + 1) if d in edges]
        at = 0
        while True:
            distance = (codes[at] ^ code).bit_count()
            down = children[at].setdefault(distance, place)
            if down == place:
                return near
            at = down


def _links(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree, parent = None, Tree(radius), []
        left: list[int] = []
        right: list[int] = []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for key, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != current:
                    current, tree, parent = key, Tree(radius), []
                unsigned = code & 0xFFFFFFFFFFFFFFFF
                place = len(parent)
                parent.append(place)
                for other in tree.add(unsigned):
                    r = root(other)
                    if r != root(place):  # links within one tree that add nothing to its components are left out
                        parent[r] = root(place)
                        left.append(_signed(tree.codes[other]))
                        right.append(code)
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
            left, right = [], []
    return search


def _parts(rows: DataFrame, bits: int) -> DataFrame:
    """Each of ``rows`` (key, rest, code) in four shards, by a quarter of its ``bits`` remaining bits."""
    width = bits // 4
    out = []
    for i in range(4):
        low = bits - width * (i + 1)
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << width) - 1))
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", low + width), low) if i else F.lit(0)
        out.append(F.struct(F.concat_ws(".", "key", F.lit(i), value).alias("key"),
                            above.bitwiseOR(below).cast("long").alias("rest")))
    return rows.select("code", F.explode(F.array(*out)).alias("e")).select("e.key", "e.rest", "code")


def links(codes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct codes (column ``code``) at most ``radius`` (up to 3) bits apart.

    Not every such pair is listed, but the components of the links are those of all pairs.
    """
    if radius > 3:
        raise ValueError("four parts find codes up to three bits apart")
    rows = codes.select(F.lit("").alias("key"), F.col("code").alias("rest"), "code")
    found = None
    for level, bits in enumerate(LEVELS):
        rows = _parts(rows, bits)
        large = None
        if level < len(LEVELS) - 1:
            large = rows.groupBy("key").count().where(F.col("count") > shard_rows).select("key").checkpoint()
            large = None if large.isEmpty() else large
        small = rows if large is None else rows.join(large, "key", "left_anti")
        tree = small.select("key", "code").repartition("key").sortWithinPartitions("key", "code").mapInArrow(
            _links(radius), "a long, b long")
        found = tree if found is None else found.union(tree)
        if large is None:
            break
        rows = rows.join(large, "key", "left_semi")
    return found


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and class of each of ``documents`` (doc_id, text): doc_id, code, component_id.

    ``component_id`` is the smallest doc_id reachable over links between fingerprints, the document's own included.
    NULL and wordless texts have fingerprint zero, linked like any other. A row without doc_id belongs to its class but
    doesn't name it; a class of such rows only has a NULL component_id. Repeated rows give repeated rows.
    Copies are reduced to one fingerprint before anything is compared.
    """
    coded = documents.select("doc_id", fingerprint("text").alias("code")).checkpoint()
    codes = coded.groupBy("code").agg(F.min("doc_id").alias("first"))
    roots = components(links(codes.select("code"), radius))
    rooted = codes.join(roots, codes["code"] == roots["node"], "left").select(
        "code", "first", F.coalesce("root", "code").alias("root")).checkpoint()
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(
        F.col("code").alias("_code"), "component_id")
    return coded.join(named, F.col("code") == F.col("_code")).select("doc_id", "code", "component_id")


def hexadecimal(code: str):
    return F.lower(F.lpad(F.hex(F.col(code)), 16, "0"))
