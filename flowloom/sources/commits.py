"""One commit for everything that a batch writes.

A batch writes the data of each sink to folders of its own and then, last, a manifest that lists them. Readers follow the
manifests, so what a batch wrote is visible as a whole or not at all, and what a failed attempt left behind is never read.
Compaction writes larger folders and one manifest that stands for all batches up to some number, again in one step.

Layout of a store: ``data/<sink>/part=<name>/...``, ``_commits/<batch>.json``, ``_compactions/<number>.json``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """Small files of a store, through Hadoop's file system on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.hadoop, self.root = jvm.org.apache.hadoop.fs, path.rstrip("/")
        self.system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Complete files of a folder, sorted."""
        if not self.system.exists(self._path(folder)):
            return []
        found = [status.getPath().getName() for status in self.system.listStatus(self._path(folder))]
        return sorted(n for n in found if not n.startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self.system.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Make a file appear with all its text at once. False, and nothing done, if there is one of that name."""
        target, folder = self._path(name), name.rpartition("/")[0]
        if self.system.exists(target):
            return False
        draft = self._path(f"{folder}/_{uuid.uuid4().hex}")
        stream = self.system.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        moved = self._move(draft, target)
        if not moved:
            self.system.delete(draft, False)
        return moved

    def _move(self, draft, target) -> bool:
        """Rename that fails where the target exists: of several at once, one succeeds."""
        context = self.hadoop.FileContext.getFileContext(target.toUri(), self.system.getConf())
        from pyspark import SparkContext

        none = getattr(self.hadoop, "Options$Rename").NONE
        how = SparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 1)
        how[0] = none
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(target), how)
            return True
        except Exception as failed:
            if "FileAlreadyExists" in str(failed):
                return False
            raise


def _manifest_name(number: int) -> str:
    return f"{number:015d}.json"


class Store:
    """Sinks that are committed together below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def stage(self, rows: DataFrame, sink: str, batch_id: int, by: Sequence[str] = ()) -> str:
        """Write what a sink gets of a batch, where no reader looks yet; returns the folder for ``commit``."""
        folder = f"part={batch_id}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(f"{self.path}/data/{sink}/{folder}")
        return folder

    def commit(self, batch_id: int, folders: dict[str, str]) -> bool:
        """Make a batch visible: all its sinks, once. False if it was before, by an attempt whose data then counts."""
        return self.files.publish(f"_commits/{_manifest_name(batch_id)}", json.dumps({"batch": batch_id, "folders": folders}))

    def committed(self, batch_id: int) -> bool:
        last = self._compacted()
        return batch_id <= last["upto"] or _manifest_name(batch_id) in self.files.names("_commits")

    def _compacted(self) -> dict:
        names = self.files.names("_compactions")
        return json.loads(self.files.read(f"_compactions/{names[-1]}")) if names else {"upto": -1, "folders": {}}

    def visible(self, upto: int | None = None) -> tuple[dict[str, list[str]], int]:
        """Folders of each sink that count, and the last batch among them: one compaction and the batches after it."""
        base = self._compacted()
        folders, last = {sink: [f] for sink, f in base["folders"].items()}, base["upto"]
        for name in self.files.names("_commits"):
            number = int(name.partition(".")[0])
            if number > base["upto"] and (upto is None or number <= upto):
                for sink, folder in json.loads(self.files.read(f"_commits/{name}"))["folders"].items():
                    folders.setdefault(sink, []).append(folder)
                last = max(last, number)
        return folders, last

    def read(self, sink: str, folders: Sequence[str] | None = None) -> DataFrame:
        """Rows of a sink from all committed batches, each once. The manifests name the folders, so none is listed
        that doesn't count."""
        root = f"{self.path}/data/{sink}"
        parts = self.visible()[0].get(sink, []) if folders is None else folders
        if not parts:
            raise ValueError(f"nothing is committed to {sink}")
        return self.spark.read.option("basePath", root).parquet(*[f"{root}/{p}" for p in parts]).drop("part")

    def compact(self, upto: int, by: dict[str, Sequence[str]] | None = None, order: dict[str, Sequence[str]] | None = None,
                files: int = 8) -> None:
        """Bring the batches up to ``upto`` into few files. What earlier compactions hold is carried along.

        ``order`` names the columns whose ranges the files of a sink hold, so that a day with many rows gets several.
        """
        folders, last = self.visible(upto)
        merged = {}
        for sink, parts in folders.items():
            rows, spread = self.read(sink, parts), (order or {}).get(sink)
            rows = rows.repartitionByRange(files, *spread) if spread else rows.repartition(files)
            merged[sink] = self.stage(rows, sink, last, (by or {}).get(sink, ()))
        number = len(self.files.names("_compactions"))
        if not self.files.publish(f"_compactions/{_manifest_name(number)}", json.dumps({"upto": last, "folders": merged})):
            raise ValueError("another compaction came first")


def day_of(scored: DataFrame) -> DataFrame:
    return scored.withColumn("day", F.to_date("timestamp"))
