"""Exact top-k search by inner product: a Voronoi join.

Vectors are grouped by their nearest pivot. A few numbers for each group (its size, its radius, the distances of its
nearest members) bound every score between a query and a group from both sides, so a query visits only the groups that
can hold one of its k best. In a group that it visits, a member scores at most the pivot's score and as much more as its own
distance from the pivot allows, so members nearer than some distance are spared too: a group's rows are sent only from the
least distance that any of its queries needs. Groups are cut into blocks and the queries into slices of bounded size, so
that a task multiplies a block by a slice whatever a group's share of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: As many pivots as the square root of the rows, between these bounds.
PIVOTS = 64, 1024
BLOCK_ROWS = 4096
SLICE_ROWS = 2048
SCALE = 1024
EXACT = 2.0 ** 53


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vectors`` (vec_id, embedding) with integer components floor(scale * x).

    Rows whose vec_id or vector is NULL, or that hold a NULL or non-finite component, are left out; so are those of
    another length than most (of equally common lengths the longest counts), which have no inner product with them.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", "embedding")
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("embedding") == (usual["n"] if usual else 0))
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vector"))


def choose_pivots(vectors: DataFrame, pivots: int | None = None) -> np.ndarray:
    """``pivots`` vectors, chosen by a hash of vec_id. Any choice is right; it only decides how much is pruned."""
    if pivots is None:
        pivots = min(PIVOTS[1], max(PIVOTS[0], round(vectors.count() ** 0.5)))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vector").collect()
    return np.unique(np.array([r[0] for r in rows], dtype=float), axis=0) if rows else np.zeros((0, 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), dtype=float)


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``home`` (number of the nearest pivot) and ``away`` (distance to it)."""
    norms = (pivots ** 2).sum(1)

    @F.pandas_udf("home int, away double")
    def nearest(vector: pd.Series) -> pd.DataFrame:
        x = _matrix(vector)
        home = (norms - 2 * x @ pivots.T).argmin(1)
        return pd.DataFrame({"home": home.astype("int32"), "away": np.sqrt(((x - pivots[home]) ** 2).sum(1))})

    return vectors.withColumn("near", nearest("vector")).select("vec_id", "vector", "near.home", "near.away")


def visits(queries: DataFrame, pivots: np.ndarray, summary: pd.DataFrame, k: int) -> DataFrame:
    """The groups that each query must visit: adds ``home`` and ``least``, the distance that members must have.

    A member at distance d from its pivot p scores between q.p - |q| d and q.p + |q| d. The k + 1 best lower bounds
    among the listed members (one may be the query itself) give the score to reach.
    """
    norm_slack = 1e-9
    near = summary["near"].map(lambda v: list(v) + [np.inf] * (k + 1 - len(v)))
    near = np.array(near.to_list(), dtype=float).reshape(len(summary), k + 1)
    radius, groups = summary["radius"].to_numpy(float), summary["home"].to_numpy(int)

    @F.pandas_udf("array<struct<home int, least double>>")
    def wanted(vector: pd.Series) -> pd.Series:
        q = _matrix(vector)
        norm = np.sqrt((q ** 2).sum(1))
        centre = q @ pivots[groups].T
        out = []
        for c, n in zip(centre, norm, strict=True):
            low = (c[:, None] - (n * near if n else np.where(np.isinf(near), np.inf, 0))).ravel()
            reach = np.partition(low, -(k + 1))[-(k + 1)] if low.size > k else -np.inf
            high = c + n * radius
            visited = high >= reach - norm_slack * (1 + np.abs(high))
            least = np.zeros(len(c)) if not n or np.isinf(reach) else (reach - c) / n
            least -= 1e-6 * (1 + np.abs(least))
            out.append([{"home": int(g), "least": float(d)} for g, d in zip(groups[visited], least[visited], strict=True)])
        return pd.Series(out)

    return queries.withColumn("visit", F.explode(wanted("vector"))).select(*queries.columns, "visit.home", "visit.least")


def _block_topk(k: int):
    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if data.empty or asked.empty:
            return out
        x, ids = _matrix(data["vector"]), data["vec_id"].to_numpy()
        q = _matrix(asked["vector"])
        if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1]) < EXACT:
            scores = (q @ x.T).astype("int64")
        else:
            scores = np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q])
        by_id = np.argsort(ids, kind="stable")
        ids, scores = ids[by_id], scores[:, by_id]
        parts = []
        for query, row in zip(asked["vec_id"].to_numpy(), scores, strict=True):
            other = ids != query
            best = np.argsort(-row[other], kind="stable")[:k]
            parts.append(pd.DataFrame({"query_id": query, "vec_id": ids[other][best], "score": row[other][best]}))
        return pd.concat(parts)
    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int | None = None, block_rows: int = BLOCK_ROWS,
          slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The ``k`` highest inner products of each query with all other vectors: query_id, rank, vec_id, score.

    Both sides are (vec_id, vector of whole numbers). Ties go to the smaller vec_id; a query with fewer candidates gets
    all; a vector that is repeated under one vec_id counts once for each row; without vectors there are no rows.
    """
    centres = choose_pivots(vectors, pivots)
    schema = "query_id long, rank int, vec_id long, score long"
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], schema)
    data = assign(vectors, centres).checkpoint()
    closest = Window.partitionBy("home").orderBy("away")
    listed = data.select("home", "away", F.row_number().over(closest).alias("place")).where(F.col("place") <= k + 1)
    radius = data.groupBy("home").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    # one row and k + 1 numbers for each of at most ``pivots`` groups
    summary = radius.join(listed.groupBy("home").agg(F.sort_array(F.collect_list("away")).alias("near")), "home").toPandas()
    asked = visits(queries.select("vec_id", "vector"), centres, summary, k).checkpoint()
    # one row for each of at most as many groups as pivots: blocks of the rows, slices of the queries, least distance
    sizes = {int(h): -(-int(n) // block_rows) for h, n in zip(summary["home"], summary["n"], strict=True)}
    load = [(int(r[0]), sizes[int(r[0])], -(-int(r[1]) // slice_rows), float(r[2])) for r in asked.groupBy("home").agg(
        F.count(F.lit(1)), F.min("least")).collect()]
    plan = F.broadcast(vectors.sparkSession.createDataFrame(load, "home int, blocks int, slices int, nearest double"))
    zero = F.lit(0)
    cells = data.join(plan, "home").where(F.col("away") >= F.col("nearest")).select(
        "home", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"),
        F.explode(F.sequence(zero, F.col("slices") - 1)).alias("slice"), "vec_id", "vector")
    questions = asked.join(plan, "home").select(
        "home", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("vec_id", zero), "slices").alias("slice"), F.col("vec_id").alias("vec_id"), F.col("vector").alias("vector"))
    cell = ["home", "block", "slice"]
    cells = cells.withColumn("block", F.col("block").cast("int"))
    questions = questions.withColumn("slice", F.col("slice").cast("int"))
    found = cells.groupBy(*cell).cogroup(questions.groupBy(*cell)).applyInPandas(
        _block_topk(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


