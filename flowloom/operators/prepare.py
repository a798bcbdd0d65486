"""Row preparation for learning: keys, features, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.schema import KEY_FIELDS, MODEL_FIELDS, RECORD_FIELDS


def add_class(flows: DataFrame, label: str = "live") -> DataFrame:
    """Attach the constant class that live captures carry."""
    return flows.withColumn("class", F.lit(label))


def binary_label(label: Column) -> Column:
    """``'0'`` is normal traffic, anything else an alert.  Text comparison: ``'0.0'`` is an alert.  A missing
    class has no label."""
    return F.when(label == "0", 0.0).when(label.isNotNull(), 1.0)


def to_float(df: DataFrame, columns: Sequence[str] = MODEL_FIELDS) -> DataFrame:
    """Cast to DOUBLE; values that are not numbers become NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def to_text(df: DataFrame, columns: Sequence[str] = MODEL_FIELDS) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def split_key(flows: DataFrame, features: Sequence[str] = MODEL_FIELDS) -> DataFrame:
    """Key columns, the features as one DOUBLE array, and what else identifies the row."""
    return flows.select(*KEY_FIELDS, F.array(*[F.col(c).try_cast("double") for c in features]).alias("features"),
                        *[c for c in ("class", "flow_start") if c in flows.columns])


def drop_features(df: DataFrame, indices: Sequence[int], features: Sequence[str] = MODEL_FIELDS) -> DataFrame:
    """Drop features by position."""
    return df.drop(*[features[i] for i in indices])


def reduce_features(df: DataFrame, indices: Sequence[int], features: Sequence[str] = MODEL_FIELDS) -> DataFrame:
    """Keep the key and the chosen features, in the given order."""
    return df.select(*[c for c in df.columns if c not in features], *[features[i] for i in indices])


def named_features(flows: DataFrame, fields: Sequence[str] = RECORD_FIELDS[:44]) -> DataFrame:
    """The record as one name-to-text map."""
    names = F.array(*[F.lit(c) for c in fields])
    values = F.array(*[F.col(c).cast("string") for c in fields])
    return flows.select(*[c for c in ("flow_start",) if c in flows.columns],
                        F.map_from_arrays(names, values).alias("document"))


def labelled_points(flows: DataFrame, features: Sequence[str] = MODEL_FIELDS,
                    output: str = "features") -> DataFrame:
    """``label`` and a feature vector on the same row; nothing is joined by position.  Rows without a label or
    with a feature that is no number are left to ``unusable_rows``."""
    good, _ = usable_rows(to_float(flows, features).withColumn("label", binary_label(F.col("class"))),
                          ["label", *features])
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error").transform(good)


def usable_rows(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in which all ``columns`` have a value, and the others; every row is in one of the two."""
    # as settled values: conditions on them must not repeat the expressions that made them
    rows = rows.select(F.inline(F.array(F.struct(*[F.col(c) for c in rows.columns]))))
    gap = F.array_contains(F.array(*[F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False))
                                     for c in columns]), True)
    return rows.filter(~gap), rows.filter(gap)


def unusable_rows(flows: DataFrame, features: Sequence[str] = MODEL_FIELDS) -> DataFrame:
    """Labelled flows that can't teach or be tested, with the ``reason``."""
    typed = to_float(flows, features).withColumn("label", binary_label(F.col("class")))
    _, bad = usable_rows(typed, ["label", *features])
    return bad.withColumn("reason", F.when(F.col("label").isNull(), "no class").otherwise("feature"))


def with_prediction(flows: DataFrame, predict: Column, at: Column | None = None) -> DataFrame:
    """Append the prediction and the scoring time (the batch's own clock unless given)."""
    return flows.withColumn("predict", predict.cast("double")).withColumn(
        "timestamp", F.current_timestamp() if at is None else at)
