"""Capture files as a data source to write to: ``frames.write.format("pcap").mode("append").save(folder)``.

Each task streams its frames into a file of its own beside the folder; the files move into it when all tasks are done, so
a failed job leaves no half capture. ``read_captures`` reads them back.
"""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from flowloom.sources import growing

register_pickle_by_value(growing)
register_pickle_by_value(sys.modules[__name__])

FORMAT = "pcap"
# Little-endian header with microseconds, version 2.4, longest record, Ethernet.
HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, 1)
_RECORD = "<IIII"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    frames: int


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.ts, self.frame = names.index("ts"), names.index("frame")
        self.draft = f"{self.path}/_drafts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = growing.open_folder(self.draft)
        name, count, out = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.pcap", 0, None
        try:
            for batch in iterator:
                if out is None and batch.num_rows:
                    system.create_dir(folder)
                    out = system.open_output_stream(f"{folder}/{name}")
                    out.write(HEADER)
                parts = []
                for ts, frame in zip(batch.column(self.ts).to_pylist(), batch.column(self.frame).to_pylist(), strict=True):
                    seconds, micros = divmod(round(ts * 1_000_000), 1_000_000)
                    parts += [struct.pack(_RECORD, seconds, micros, len(frame), len(frame)), frame]
                    count += 1
                if parts:
                    out.write(b"".join(parts))
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, count)

    def commit(self, messages: list[Written | None]) -> None:
        system, draft = growing.open_folder(self.draft)
        _, folder = growing.open_folder(self.path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    system.delete_file(info.path)
        for message in messages:
            if message is not None and message.name:
                system.move(f"{draft}/{message.name}", f"{folder}/{message.name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, draft = growing.open_folder(self.draft)
        if system.get_file_info(draft).type == fs.FileType.Directory:
            system.delete_dir(draft)


class CaptureFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "num long, ts double, frame binary"

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], schema.names, overwrite)


def write_captures(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Frames (``ts`` in seconds, ``frame``) as capture files below ``path``, one for each partition; their names have the order of the
    partitions, so sorted frames make one capture in several files (``read_captures`` with ``rotated``)."""
    frames.sparkSession.dataSource.register(CaptureFiles)
    frames.select("ts", "frame").write.format(FORMAT).mode(mode).save(path)
