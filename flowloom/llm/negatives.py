"""Hard negatives with an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own, so that a pair of code words is a cell. An inner product
is the sum of its halves' products, and with a code word's radius each half has a bound; the cells come in the order of
the summed bounds from a heap over the two sorted lists (multi-sequence), without forming all sums. A search stops at the
first cell whose bound lies below what it still needs: the last of the positives found, or, for negatives, the last found
of each positive's window. Cells are packed into shards of bounded size (a cell with more rows gets several), and anchors
go only to shards that hold a cell which they need, in slices of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import stored

SCALE, LABELS = 256, 10
POSITIVES, NEGATIVES = 5, 5
#: Negatives score at least this share of the positive's score, in hundredths, and at most all of it.
LEAST_SHARE = 80
#: Rows that fit the codebooks and give anchors their first bounds; chosen by a hash of vec_id.
SAMPLE = 8192
#: Rows a cell should hold; code words of each half, at most.
CELL_ROWS, WORDS = 256, 64
SHARD_ROWS, SLICE_ROWS = 16_384, 1024
#: Anchors whose way through the cells one task finds.
ROUTED = 512
ROUNDS = 12
_EXACT = 2.0 ** 53
_FOUND = "anchor_id long, place int, vec_id long, score long"


def labelled(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) that take part: vec_id, label, vector of whole numbers.

    Rows with a NULL id, label or vector, with a NULL or non-finite component, or of another length than most (of equally
    common lengths the longest counts) take no part. Where 7 divides vec_id, the label becomes the next one.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", "embedding", "label")
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("embedding") == (usual["n"] if usual else 0))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.select("vec_id", label.cast("long").alias("label"),
                       F.transform(x, lambda v: F.floor(v * SCALE).cast("double")).alias("vector"))


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs (a[i] + b[j], i, j) by falling sum, made as they are asked for."""
    first, second = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    if not first or not second:
        return
    heap = [(-(a[first[0]] + b[second[0]]), 0, 0)]
    while heap:
        low, i, j = heapq.heappop(heap)
        yield -low, first[i], second[j]
        if j + 1 < len(second):
            heapq.heappush(heap, (-(a[first[i]] + b[second[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(a[first[i + 1]] + b[second[0]]), i + 1, 0))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.to_list(), dtype=float).reshape(len(column), width)


def _codebook(points: np.ndarray, words: int) -> np.ndarray:
    """``words`` centres of ``points`` or fewer (Lloyd's rounds from the first different points)."""
    _, first = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(first)[:words]].copy()
    for _ in range(ROUNDS):
        near = _nearest(points, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2 * points @ centres.T).argmin(1)


class Index:
    """Codebooks of both halves, the radii of their words, and the sample. Its size doesn't grow with the table."""

    def __init__(self, sample: pd.DataFrame, rows: int):
        self.width = len(sample["vector"].iloc[0])
        self.vectors = _matrix(sample["vector"], self.width)
        self.ids, self.labels = sample["vec_id"].to_numpy(np.int64), sample["label"].to_numpy(np.int64)
        words = int(min(WORDS, max(1, round((rows / CELL_ROWS) ** 0.5))))
        self.half = self.width // 2
        self.books = [_codebook(x, words) for x in self.halves(self.vectors)]
        self.radii = [np.zeros(len(b)) for b in self.books]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., :self.half], x[..., self.half:]

    def codes(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Code words of both halves, and the distances to them."""
        words = [_nearest(h, b) for h, b in zip(self.halves(x), self.books, strict=True)]
        away = [np.sqrt(((h - b[w]) ** 2).sum(1)) for h, b, w in zip(self.halves(x), self.books, words, strict=True)]
        return words, away

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half, the most that a vector of each word can add to the score of ``q``, rounding included."""
        high = [b @ h + np.sqrt(h @ h) * r for h, b, r in zip(self.halves(q), self.books, self.radii, strict=True)]
        return [v + 1e-9 * (1 + np.abs(v)) for v in high]


def _scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of ``rows`` with ``q``."""
    if np.abs(rows).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < _EXACT:
        return (rows @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows], dtype=np.int64)


def _kth(values: np.ndarray, k: int, default: float) -> float:
    return float(np.partition(values, -k)[-k]) if len(values) >= k else default


def _window(positive: int) -> tuple[float, float]:
    """Lowest and highest score of a negative for a positive's score; empty below zero."""
    return -(-LEAST_SHARE * positive // 100), positive


def fit(vectors: DataFrame) -> tuple[Index, DataFrame, DataFrame] | None:
    """The index of ``vectors``, their rows with cell and shard numbers, and the table of cells; None without rows."""
    rows = vectors.count()
    if not rows:
        return None
    order = F.xxhash64("vec_id", F.lit("sample"))
    thinned = vectors.where(F.pmod(order, F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE / rows) * (1 << 30)))
    sample = thinned.orderBy(order, "vec_id").limit(SAMPLE).select("vec_id", "label", "vector").toPandas()
    if sample.empty:
        sample = vectors.limit(1).toPandas()
    index = Index(sample, rows)
    blank = index.vectors, index.ids, index.labels
    index.vectors = index.ids = index.labels = None  # the sample isn't needed for coding
    books = vectors.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("first int, second int, away_1 double, away_2 double")
    def coded(vector: pd.Series) -> pd.DataFrame:
        words, away = books.value.codes(_matrix(vector, books.value.width))
        return pd.DataFrame({"first": words[0].astype("int32"), "second": words[1].astype("int32"),
                             "away_1": away[0], "away_2": away[1]})

    table = stored(vectors.withColumn("c", coded("vector")).select("vec_id", "label", "vector", "c.*"), "cells")
    # at most WORDS x WORDS rows
    cells = table.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.max("away_1").alias("away_1"),
                                                 F.max("away_2").alias("away_2")).toPandas().sort_values(["first", "second"])
    for half, (word, away) in enumerate((("first", "away_1"), ("second", "away_2"))):
        np.maximum.at(index.radii[half], cells[word].to_numpy(), cells[away].to_numpy())
    index.vectors, index.ids, index.labels = blank
    shard, held, packed = 0, 0, []
    for n in cells["n"].tolist():
        pieces = -(-n // SHARD_ROWS)
        if held and (pieces > 1 or held + n > SHARD_ROWS):
            shard, held = shard + 1, 0
        packed.append((shard, pieces))
        shard, held = (shard + pieces, 0) if pieces > 1 else (shard, held + n)
    cells["shard"], cells["pieces"] = zip(*packed, strict=True)
    known = vectors.sparkSession.createDataFrame(
        cells[["first", "second", "shard", "pieces"]].astype("int64").values.tolist(),
        "first int, second int, shard long, pieces long")
    rows_of = table.join(F.broadcast(known), ["first", "second"]).select(
        "vec_id", "label", "vector", "first", "second",
        (F.col("shard") + F.pmod(F.xxhash64("vec_id", F.lit("piece")), F.col("pieces"))).alias("shard"))
    return index, rows_of, cells


def _route(anchors: DataFrame, index: Index, cells: pd.DataFrame, reach: Callable) -> DataFrame:
    """``anchors`` once for each shard that holds a cell they need: adds ``reach`` and ``shard``.

    ``reach`` gives, from the sample, the score below which an anchor needs nothing.
    """
    places = {(f, s): range(shard, shard + pieces) for f, s, shard, pieces in zip(
        cells["first"], cells["second"], cells["shard"], cells["pieces"], strict=True)}
    held = anchors.sparkSession.sparkContext.broadcast((index, places))

    @F.pandas_udf("reach double, shards array<long>")
    def visited(vec_id: pd.Series, label: pd.Series, vector: pd.Series, positives: pd.Series) -> pd.DataFrame:
        index, places = held.value
        reaches, shards = [], []
        for i, l, q, p in zip(vec_id, label, _matrix(vector, index.width), positives, strict=True):
            low = reach(index, i, l, q, p)
            found: set[int] = set()
            for high, first, second in multi_sequence(*index.bounds(q)):
                if high < low:
                    break
                found.update(places.get((first, second), ()))
            reaches.append(low)
            shards.append(sorted(found))
        return pd.DataFrame({"reach": reaches, "shards": pd.Series(shards, dtype=object)})

    anchors = anchors.repartition(-(-anchors.count() // ROUTED) or 1)
    routed = anchors.withColumn("r", visited("vec_id", "label", "vector", "positives"))
    return routed.select("vec_id", "label", "vector", "positives", "r.reach", F.explode("r.shards").alias("shard"))


def _reach_positives(index: Index, vec_id: int, label: int, q: np.ndarray, positives) -> float:
    same = (index.labels == label) & (index.ids != vec_id)
    return _kth(_scores(index.vectors[same], q), POSITIVES, -np.inf)


def _reach_negatives(index: Index, vec_id: int, label: int, q: np.ndarray, positives) -> float:
    other = (index.labels != label) & (index.ids != vec_id)
    return _needed(_scores(index.vectors[other], q), positives)


def _needed(scores: np.ndarray, positives) -> float:
    """The score that a further negative must reach to enter the window of any of ``positives``."""
    low = np.inf
    for positive in positives:
        least, most = _window(int(positive))
        if least <= most:
            low = min(low, max(least, _kth(scores[scores <= most], NEGATIVES, least)))
    return low


class Local:
    """The rows of one shard by cell, searched for one anchor after the other."""

    def __init__(self, index: Index, data: pd.DataFrame):
        data = data.sort_values(["first", "second"], kind="stable")
        self.index, self.x = index, _matrix(data["vector"], index.width)
        self.ids, self.labels = data["vec_id"].to_numpy(np.int64), data["label"].to_numpy(np.int64)
        first, second = data["first"].to_numpy(), data["second"].to_numpy()
        cuts = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(data)]])
        self.words = [np.unique(first), np.unique(second)]
        self.cells = {(first[a], second[a]): (a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, slice]]:
        """This shard's cells by falling bound."""
        high = [b[w] for b, w in zip(self.index.bounds(q), self.words, strict=True)]
        for bound, i, j in multi_sequence(*high):
            cell = self.cells.get((self.words[0][i], self.words[1][j]))
            if cell is not None:
                yield bound, slice(*cell)

    def _rows(self, cell: slice, vec_id: int, chosen: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(chosen[cell] & (self.ids[cell] != vec_id)) + cell.start
        return self.ids[at], _scores(self.x[at], q)

    def positives(self, vec_id: int, label: int, q: np.ndarray, reach: float, same: np.ndarray) -> list[tuple]:
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for bound, cell in self.visit(q):
            if bound < reach:
                break
            more, score = self._rows(cell, vec_id, same, q)
            ids, scores = np.concatenate([ids, more]), np.concatenate([scores, score])
            best = np.lexsort((ids, -scores))[:POSITIVES]
            ids, scores = ids[best], scores[best]
            if len(ids) == POSITIVES:
                reach = max(reach, float(scores[-1]))
        return [(vec_id, 0, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]

    def negatives(self, vec_id: int, q: np.ndarray, reach: float, positives: list, other: np.ndarray) -> list[tuple]:
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        most = max(positives)
        for bound, cell in self.visit(q):
            if bound < reach:
                break
            more, score = self._rows(cell, vec_id, other, q)
            kept = (score >= reach) & (score <= most)
            if kept.any():
                ids, scores = np.concatenate([ids, more[kept]]), np.concatenate([scores, score[kept]])
                reach = max(reach, _needed(scores, positives))
                kept = scores >= reach
                ids, scores = ids[kept], scores[kept]
        out = []
        for place, positive in enumerate(positives):
            low, high = _window(positive)
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            best = inside[np.lexsort((ids[inside], -scores[inside]))[:NEGATIVES]]
            out += [(vec_id, place, i, s) for i, s in zip(ids[best].tolist(), scores[best].tolist(), strict=True)]
        return out


def _search(rows: DataFrame, asked: DataFrame, index: Index, negatives: bool) -> DataFrame:
    """What each of ``asked`` finds in its shards: anchor_id, place, vec_id, score."""
    light = Index.__new__(Index)
    light.__dict__.update(index.__dict__, vectors=None, ids=None, labels=None)
    held = rows.sparkSession.sparkContext.broadcast(light)

    def found(data: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(data) and len(anchors):
            local = Local(held.value, data)
            chosen: dict[int, np.ndarray] = {}
            queries = _matrix(anchors["vector"], held.value.width)
            for i, label, q, reach, positives in zip(anchors["vec_id"].tolist(), anchors["label"].tolist(), queries,
                                                     anchors["reach"].tolist(), anchors["positives"], strict=True):
                if label not in chosen:
                    chosen[label] = (local.labels == label) != negatives
                out += (local.negatives(i, q, reach, [int(p) for p in positives], chosen[label]) if negatives
                        else local.positives(i, label, q, reach, chosen[label]))
        made = pd.DataFrame(out, columns=["anchor_id", "place", "vec_id", "score"], dtype="int64")
        return made.astype({"place": "int32"})

    load = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    cut = rows.join(load, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    questions = asked.join(load, "shard").withColumn(
        "slice", F.pmod(F.xxhash64("vec_id", F.lit("slice")), F.col("slices").cast("long")).cast("int"))
    cells = cut.select("shard", "slice", "vec_id", "label", "vector", "first", "second")
    questions = questions.select("shard", "slice", "vec_id", "label", "vector", "positives", "reach")
    return cells.groupBy("shard", "slice").cogroup(questions.groupBy("shard", "slice")).applyInPandas(found, _FOUND)


def _first(found: DataFrame, group: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Hard negatives of ``anchors`` among ``vectors`` (both vec_id, label, vector, as ``labelled`` makes them).

    An anchor's positives are its first ``POSITIVES`` other rows of its label. For each, the first ``NEGATIVES`` rows of
    other labels whose score is within the window below the positive's are returned: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. Higher scores come first, ties by smaller vec_id. Rows with the
    anchor's vec_id are not its candidates; other rows that share a vec_id each count; of anchors that share one, that
    with the smallest label, then vector, is asked. A positive below zero has no window. Without rows there are none.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    fitted = fit(vectors)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    index, rows, cells = fitted
    none = F.array().cast("array<long>")
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select(
        "vec_id", "a.label", "a.vector", none.alias("positives")).checkpoint()
    found = _search(rows, _route(asked, index, cells, _reach_positives), index, negatives=False)
    positives = _first(found, ["anchor_id"], POSITIVES).select(
        "anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")).checkpoint()
    lists = positives.groupBy("anchor_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("ps"))
    again = asked.join(lists, asked["vec_id"] == lists["anchor_id"]).select(
        "vec_id", "label", "vector", F.col("ps").alias("positives")).where(F.exists("positives", lambda p: p >= 0)).checkpoint()
    found = _search(rows, _route(again, index, cells, _reach_negatives), index, negatives=True)
    best = _first(found, ["anchor_id", "place"], NEGATIVES)
    return best.join(positives, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same, list_dot_product(a.v, c.v)::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (
  select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::integer as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same
    and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
  where place <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""
