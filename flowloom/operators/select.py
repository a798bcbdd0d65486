"""Feature statistics and selection.

Moments over any number of rows come from Spark ML's distributed summaries; what reaches the driver is one
value per feature pair, whatever the data size.  The summaries read their input more than once, so it is kept
on the executors (spilling to their disks) until they are done.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@contextmanager
def _vectors(df: DataFrame, features: Sequence[str]):
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    vectors = (VectorAssembler(inputCols=list(features), outputCol="v", handleInvalid="error")
               .transform(doubles).select("v").persist(StorageLevel.MEMORY_AND_DISK))
    try:
        yield vectors
    finally:
        vectors.unpersist()


def _correlations(vectors: DataFrame) -> DataFrame:
    matrix = Correlation.corr(vectors, "v", "pearson").head()[0].toArray()
    rows = [(i, j, float(value)) for i, line in enumerate(matrix) for j, value in enumerate(line)]
    pairs = vectors.sparkSession.createDataFrame(rows, "i int, j int, corr double")
    return pairs.withColumn("corr", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.nanvl("corr", F.lit(0.0))))


def _variances(vectors: DataFrame, features: Sequence[str]) -> DataFrame:
    summary = vectors.select(Summarizer.variance(F.col("v")).alias("s")).head()[0].toArray()
    rows = [(i, name, float(value)) for i, (name, value) in enumerate(zip(features, summary))]
    return vectors.sparkSession.createDataFrame(rows, "i int, name string, variance double")


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson matrix as rows (i, j, corr).  Constant columns correlate 0 with others and 1 with themselves."""
    with _vectors(df, features) as vectors:
        return _correlations(vectors)


def feature_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sample variance of each feature as rows (i, name, variance)."""
    with _vectors(df, features) as vectors:
        return _variances(vectors, features)


def feature_weights(df: DataFrame, features: Sequence[str], heuristic: str = "variance_ratio") -> DataFrame:
    """Weight of each feature: variance over summed absolute correlation, or the latter alone
    (``heuristic='corr_sum'``)."""
    if heuristic not in ("variance_ratio", "corr_sum"):
        raise ValueError(f"unknown heuristic {heuristic!r}")
    with _vectors(df, features) as vectors:
        related = _correlations(vectors).groupBy("i").agg(F.sum(F.abs("corr")).alias("corr_sum"))
        names = _variances(vectors, features)
    weight = F.col("corr_sum") if heuristic == "corr_sum" else F.col("variance") / F.col("corr_sum")
    return names.join(related, "i").select(F.col("i").alias("idx"), "name", weight.alias("weight"))


def top_features(weights: DataFrame, k: int = 6) -> DataFrame:
    """The k heaviest features; of equal weights the larger index comes first."""
    return weights.orderBy(F.desc("weight"), F.desc("idx")).limit(k)


def select_features(df: DataFrame, features: Sequence[str], k: int = 6,
                    heuristic: str = "variance_ratio") -> list[int]:
    """Indices of the chosen features, heaviest first."""
    return [row["idx"] for row in top_features(feature_weights(df, features, heuristic), k).collect()]


def cluster_features(df: DataFrame, features: Sequence[str], k: int = 6, seed: int = 0) -> DataFrame:
    """Group features whose correlation profiles are alike: k-means over the rows of the matrix."""
    profile = (correlation_pairs(df, features).groupBy("i")
               .agg(F.array_sort(F.collect_list(F.struct("j", "corr"))).alias("cells"))
               .select("i", array_to_vector(F.col("cells.corr")).alias("features")))
    fitted = KMeans(k=k, seed=seed).fit(profile)
    return fitted.transform(profile).select(F.col("i").alias("idx"), F.col("prediction").alias("cluster"))
