"""Classifier evaluation.  Every metric derives from the confusion counts: one pass, one row per label pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """Rows (label, prediction, n) that occur."""
    return (predictions.select(F.col("label").cast("double"), F.col("prediction").cast("double"))
            .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(predictions: DataFrame, labels: tuple[float, ...] = (0.0, 1.0)) -> DataFrame:
    """One row per actual label, one column per predicted label, ascending."""
    return (confusion_counts(predictions).groupBy("label")
            .agg(*[F.coalesce(F.sum(F.when(F.col("prediction") == p, F.col("n"))), F.lit(0).cast("bigint"))
                   .alias(f"predicted_{int(p)}") for p in labels])
            .orderBy("label"))


def overall_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, test error, and precision, recall and F-measure without a label, which are micro averages
    and so equal the accuracy."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    accuracy = F.try_divide(right, F.sum("n"))
    return confusion_counts(predictions).agg(
        accuracy.alias("accuracy"), accuracy.alias("precision"), accuracy.alias("recall"),
        accuracy.alias("f_measure"), (F.lit(1.0) - accuracy).alias("test_error"), F.sum("n").alias("rows"))


def class_metrics(predictions: DataFrame) -> DataFrame:
    """Per label: precision, recall (the true positive rate), false positive rate and F1."""
    counts = confusion_counts(predictions)
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("actual"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")))).alias("s")).select("s.*")
    total = counts.agg(F.sum("n").alias("total")).select("total").scalar()
    c = F.col
    per_label = sides.groupBy("label").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    return per_label.select(
        "label", "actual", "predicted",
        F.try_divide(c("hit"), c("predicted")).alias("precision"),
        F.try_divide(c("hit"), c("actual")).alias("recall"),
        F.try_divide(c("predicted") - c("hit"), total - c("actual")).alias("false_positive_rate"),
        F.try_divide(c("hit") * 2, c("predicted") + c("actual")).alias("f1"))


def weighted_metrics(predictions: DataFrame) -> DataFrame:
    """Label metrics averaged by label frequency."""
    weight = F.col("actual")
    return class_metrics(predictions).agg(*[
        F.try_divide(F.sum(F.coalesce(F.col(m), F.lit(0.0)) * weight), F.sum(weight)).alias(f"weighted_{m}")
        for m in ("precision", "recall", "f1", "false_positive_rate")])
