"""Versions of a model: published one after the other, and taken up by running streams between two batches."""

from __future__ import annotations

import json
import uuid
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from flowloom.plans.model import train
from flowloom.sources.commits import Files


class Models:
    """A folder of models. ``_versions/<number>.json`` points to a stored model and appears with all its text at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.loaded: dict[int, PipelineModel] = {}

    def versions(self) -> list[int]:
        return [int(n.partition(".")[0]) for n in self.files.names("_versions")]

    def publish(self, model: PipelineModel, first: bool = False) -> int:
        """Store a model as the next version; returns its number. With ``first``, one that came before wins and counts."""
        folder = f"model-{uuid.uuid4().hex}"
        model.save(f"{self.path}/{folder}")
        while True:
            number = max(self.versions(), default=0) + 1
            if first and number > 1:
                return 1
            if self.files.publish(f"_versions/{number:09d}.json", json.dumps({"folder": folder})):
                return number

    def load(self, number: int) -> PipelineModel:
        if number not in self.loaded:
            folder = json.loads(self.files.read(f"_versions/{number:09d}.json"))["folder"]
            self.loaded = {number: PipelineModel.load(f"{self.path}/{folder}")}
        return self.loaded[number]

    def current(self) -> int:
        """The newest version; an error if there is none."""
        return max(self.versions())

    def train_or_load(self, flows: DataFrame, **training) -> tuple[int, PipelineModel]:
        """The newest version, or one trained on ``flows``. Of two jobs that train at once, the first to publish counts for
        both."""
        number = self.current() if self.versions() else self.publish(train(flows, **training), first=True)
        return number, self.load(number)

    def of_batch(self, run: str, batch_id: int) -> int:
        """The version that a stream's batch is scored with: the newest when the batch first began, also when it is repeated."""
        name = f"_batches/{run}/{batch_id:015d}.json"
        self.files.publish(name, json.dumps({"version": self.current()}))
        return json.loads(self.files.read(name))["version"]
