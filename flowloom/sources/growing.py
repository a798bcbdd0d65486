"""Text files that grow, as a streaming data source.

Spark's own text source takes a file once, when it appears. Here the offset of a stream is how far each file has been read;
a batch takes the whole lines that came since, in partitions of bounded length, and what has no line end yet waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
#: Bytes of a partition and of one read, and lines of one batch handed to Spark.
PART_BYTES, BLOCK, BATCH_LINES = 1 << 26, 1 << 20, 10_000


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for ``path`` and the path in it; a path without scheme is local."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def whole_lines_end(handle, size: int, start: int) -> int:
    """Where the last line that has ended by ``size`` ends; ``start`` if none has since."""
    end = size
    while end > start:
        begin = max(start, end - BLOCK)
        handle.seek(begin)
        at = handle.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


def lines_between(handle, start: int, stop: int, limit: int) -> Iterator[bytes]:
    """The lines that begin in [start, stop), read to their ends; no line ends after ``limit``. A line begins at ``start``
    only if the byte before ends one (or it is the beginning of the file)."""
    at, held = start, b""
    if start:
        at = start - 1
        handle.seek(at)
    else:
        handle.seek(0)
    skipping, begin = start > 0, at
    while True:
        block = handle.read(min(BLOCK, limit - at))
        if not block:
            return
        at += len(block)
        held += block
        lines = held.split(b"\n")
        held = lines.pop()
        for line in lines:
            if skipping:
                skipping = False
            elif begin < stop:
                yield line
            else:
                return
            begin += len(line) + 1
        if begin >= stop and not skipping:
            return


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, stop: int, limit: int):
        self.path, self.start, self.stop, self.limit = path, start, stop, limit


class GrowingReader(DataSourceStreamReader):
    """Offsets are {file: bytes read}. A file that became shorter is taken to be a new one and read from its beginning."""

    def __init__(self, options: dict):
        self.path, self.part_bytes = options["path"], int(options.get("partbytes", PART_BYTES))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        system, folder = open_folder(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or info.base_name.startswith((".", "_")):
                continue
            start = self.seen.get(info.path, 0)
            start = start if start <= info.size else 0
            with system.open_input_file(info.path) as handle:
                found[info.path] = whole_lines_end(handle, info.size, start)
        self.seen = found
        return {"files": found}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, out = start.get("files", {}), []
        for path, limit in sorted(end["files"].items()):
            begin = before.get(path, 0)
            begin = begin if begin <= limit else 0
            out += [Stretch(path, a, min(a + self.part_bytes, limit), limit) for a in range(begin, limit, self.part_bytes)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        with system.open_input_file(partition.path) as handle:
            rows: list[str] = []
            for line in lines_between(handle, partition.start, partition.stop, partition.limit):
                rows.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(rows) == BATCH_LINES:
                    yield pa.record_batch([pa.array(rows)], ["value"])
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(rows)], ["value"])


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").load(folder)``: each line once, as ``value``, once its end is written."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def read_growing(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of the files below ``path`` as a stream, also those that are appended later."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(FORMAT).options(**options).load(path)
