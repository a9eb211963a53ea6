"""Raw video files of any size as a data source: fixed records, read by byte ranges.

A file of a hundred gigabytes is many partitions, each a range of whole records; a task holds a batch of them. Frame k lies at k times a record's bytes,
so frames first to end, or frames that a table asks for, are read without the rest. The range is an option of the read and not a filter pushed down: Spark 4.1
shares what was pushed into a Python source between all scans of one DataFrame, so that a union of two ranges would read one of them twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import register
from .storage import file_system, files_in

SCHEMA = "file string, frame long, raw binary"
MOST = 1 << 62


@dataclass
class Range(InputPartition):
    """Records first to end of a file."""

    path: str
    first: int
    end: int


class RawFrames(DataSource):
    """Options: path, a file or a folder; record, the bytes of a frame; first and end, the frames of each file (all); partition_bytes, about how much a task reads (64 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RawFramesReader(self.options["path"], *(int(self.options.get(k, d)) for k, d in (("record", 0), ("partition_bytes", 64 << 20), ("first", 0), ("end", MOST))))


class RawFramesReader(DataSourceReader):
    """A short last record is left out, as it is no frame."""

    def __init__(self, path: str, record: int, partition_bytes: int, first: int, end: int):
        if record < 1:
            raise ValueError("a record has a byte at least")
        self.path, self.record, self.per = path, record, max(1, partition_bytes // record)
        self.first, self.end = max(0, first), end

    def partitions(self) -> list[Range]:
        out = []
        for info in files_in(self.path):
            end = min(self.end, info.size // self.record)
            out += [Range(info.path, k, min(k + self.per, end)) for k in range(self.first, end, self.per)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.end:
            return
        system, _ = file_system(self.path)
        step = max(1, (4 << 20) // self.record)
        with system.open_input_file(partition.path) as file:
            file.seek(partition.first * self.record)
            for k in range(partition.first, partition.end, step):
                n = min(step, partition.end - k)
                data = file.read(n * self.record)
                if len(data) < n * self.record:
                    raise OSError(f"{partition.path} has become shorter")
                offsets = pa.array(range(0, len(data) + 1, self.record), pa.int32())
                raw = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(range(k, k + n), pa.int64()), raw], ["file", "frame", "raw"])


def raw_frames(spark: SparkSession, path: str, record: int, first: int = 0, end: int = MOST, partition_bytes: int = 64 << 20) -> DataFrame:
    """(file, frame, raw): the whole records first to end of the files at path."""
    register(spark, RawFrames)
    options = {"record": record, "first": first, "end": end, "partition_bytes": partition_bytes}
    return spark.read.format("raw_frames").options(**options).load(path)


def frames_at(asks: DataFrame, record: int, file: str = "file", frame: str = "frame") -> DataFrame:
    """asks with raw, the bytes of that frame of that file: null beyond the file's whole records, or where one of the two is null.

    Asks are put in order by file and frame, in ranges of about equal size, so many asks of one file are many tasks, each of which reads forward.
    """
    at, number = asks.columns.index(file), asks.columns.index(frame)
    ordered = asks.repartitionByRange(file, frame).sortWithinPartitions(file, frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, n = None, None, 0
        step = max(1, (4 << 20) // record)
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part, raw = batch.slice(low, step), []
                for path, k in zip(part.column(at).to_pylist(), part.column(number).to_pylist()):
                    if path is not None and path != opened:
                        if source is not None:
                            source.close()
                        system, own = file_system(path)
                        opened, source = path, system.open_input_file(own)
                        n = source.size() // record
                    if path is None or k is None or not 0 <= k < n:
                        raw.append(None)
                    else:
                        source.seek(k * record)
                        raw.append(source.read(record))
                columns = [pa.nulls(len(c), c.type) if c.null_count == len(c) else c for c in part.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())], [*part.schema.names, "raw"])
        if source is not None:
            source.close()

    return ordered.mapInArrow(run, StructType([*asks.schema.fields, StructField("raw", BinaryType())]))
