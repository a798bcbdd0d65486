"""Training, storing and applying the classifier."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from flowloom.operators.evaluate import overall_metrics
from flowloom.operators.prepare import binary_label, to_float, usable_rows
from flowloom.operators.select import select_features
from flowloom.schema import KEY_FIELDS, MODEL_FIELDS
from flowloom.session import shared_folder


def keyed_split(df: DataFrame, key: Sequence[str], train_tenths: int = 7) -> tuple[DataFrame, DataFrame]:
    """Split by the MD5 digest of the key's text: repeatable whatever the partitioning, and by other engines."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    tenth = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10
    return df.filter(tenth < train_tenths), df.filter(tenth >= train_tenths)


def build_pipeline(indices: Sequence[int], features: Sequence[str] = MODEL_FIELDS, depth: int = 5,
                   bins: int = 32) -> Pipeline:
    """Assemble all features, slice the chosen ones, fit a decision tree.  The feature choice is a stage, so
    it is stored with the model."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="all_features", handleInvalid="error"),
        VectorSlicer(inputCol="all_features", outputCol="features", indices=list(indices)),
        DecisionTreeClassifier(labelCol="label", featuresCol="features", maxDepth=depth, maxBins=bins,
                               impurity="gini"),
    ])


def labelled(flows: DataFrame, features: Sequence[str] = MODEL_FIELDS) -> DataFrame:
    """Flows with a label and all features; ``prepare.unusable_rows`` has the others."""
    typed = to_float(flows, features).withColumn("label", binary_label(F.col("class")))
    return usable_rows(typed, ["label", *features])[0]


def train(flows: DataFrame, k: int = 6, heuristic: str = "variance_ratio",
          features: Sequence[str] = MODEL_FIELDS) -> PipelineModel:
    """Select features on labelled flows and fit the tree.  Both read the flows several times, so they are
    kept on the executors meanwhile, on disk where memory is short."""
    points = labelled(flows, features).select("label", *features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return build_pipeline(select_features(points, features, k, heuristic), features).fit(points)
    finally:
        points.unpersist()


def get_model(path: str, flows: DataFrame, **training) -> PipelineModel:
    """The model stored at ``path``, or one trained on ``flows`` and stored there."""
    try:
        return PipelineModel.load(path)
    except (AnalysisException, Py4JJavaError) as missing:
        if "does not exist" not in str(missing) and "PATH_NOT_FOUND" not in str(missing):
            raise
    model = train(flows, **training)
    model.save(path)
    return model


def selected_indices(model: PipelineModel) -> list[int]:
    return model.stages[1].getIndices()


def tree_of(model: PipelineModel) -> DecisionTreeClassificationModel:
    return model.stages[-1]


def describe_model(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row: nodes, depth, features used, and the rules as text."""
    tree = tree_of(model)
    rows = [(tree.numNodes, tree.depth, selected_indices(model), tree.toDebugString)]
    return spark.createDataFrame(rows, "nodes int, depth int, indices array<int>, rules string")


def score(model: PipelineModel, flows: DataFrame, features: Sequence[str] = MODEL_FIELDS) -> DataFrame:
    """Flows with ``predict``; works on streams too.  Key, features and prediction stay on one row.  A feature
    that is missing or no number fails the query."""
    kinds = {f.name: f.dataType for f in flows.schema.fields}
    texts = [c for c in features if not isinstance(kinds[c], NumericType)]
    if not texts:
        return model.transform(flows).select(*flows.columns, F.col("prediction").alias("predict"))
    typed = {f"_in_{c}": F.col(c) for c in texts}
    scored = model.transform(to_float(flows.withColumns(typed), texts))
    kept = [F.col(f"_in_{c}").alias(c) if c in texts else F.col(c) for c in flows.columns]
    return scored.select(*kept, F.col("prediction").alias("predict"))


def rules_column(model: PipelineModel, features: Sequence[str] = MODEL_FIELDS) -> Column:
    """The tree's rules as one column expression over the features: the prediction without the model."""
    tree, names = tree_of(model), [features[i] for i in selected_indices(model)]

    def rule(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        below = F.col(names[split.featureIndex()]).cast("double") <= F.lit(float(split.threshold()))
        return F.when(below, rule(node.leftChild())).otherwise(rule(node.rightChild()))

    return rule(tree._call_java("rootNode"))


def evaluate(model: PipelineModel, flows: DataFrame,
             features: Sequence[str] = MODEL_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Predictions (label, prediction) on labelled flows, and their overall metrics."""
    predictions = model.transform(labelled(flows, features)).select(*KEY_FIELDS, "label", "prediction")
    return predictions, overall_metrics(predictions)


def offline_run(flows: DataFrame, key: Sequence[str], **training) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Offline training and evaluation on labelled flows: 70/30 split by ``key``, model, predictions, metrics."""
    shared_folder(flows.sparkSession)
    for_training, for_testing = keyed_split(flows.checkpoint(), key)  # the flows are made once
    model = train(for_training, **training)
    return (model, *evaluate(model, for_testing, training.get("features", MODEL_FIELDS)))
