"""A stream of frames that arrive as Parquet files, with offsets and a rule of admission.

Frames lie in folders by a hash of their key, so that a key's frames are one partition's, and have a number by which they arrive. The source's offset is the
number that comes next. Under the rule "latest" the source hands on the last frame of each key that has arrived since the last batch, and the
others never enter the query: a slot that holds one frame. Under "all" every frame goes on. A restart reads the same ranges of numbers again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from ..session import register, scratch, staged
from ..sources.storage import file_system

BUCKET = "bucket"


def append_arrivals(frames: DataFrame, path: str, key: str, buckets: int = 8) -> None:
    """Adds frames to those that have arrived: a folder with a file for each bucket of keys, which counts once it is complete."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    frames.withColumn(BUCKET, bucket).repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/{uuid.uuid4().hex}")


@dataclass
class Arrived(InputPartition):
    """Files of one bucket, and the numbers that are read from them."""

    paths: list[str]
    start: int
    end: int


class FrameArrivals(DataSource):
    """Options: path; number, the column by which frames arrive (whole numbers from 0, none twice); key; admit: all or latest. The schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return "frame_arrivals"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        admit = self.options.get("admit", "all")
        if admit not in ("all", "latest"):
            raise ValueError(f"no rule of admission {admit!r}")
        return ArrivalsReader(self.options["path"], self.options["number"], self.options["key"], admit, to_arrow_schema(schema))


class ArrivalsReader(DataSourceStreamReader):
    """A batch is what has arrived since the last: numbers from start up to the greatest that a file has, that one aside."""

    def __init__(self, path: str, number: str, key: str, admit: str, schema: pa.Schema):
        self.path, self.number, self.key, self.admit, self.schema = path, number, key, admit, schema
        self.bounds: dict[str, tuple[int, int] | None] = {}

    def _known(self) -> dict[str, tuple[int, int] | None]:
        """The least and greatest number of each file, from its footer; a file is looked at once."""
        system, at = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        whole = {x.path.rpartition("/")[0] for x in found if x.base_name == "_SUCCESS"}
        for info in found:
            if info.extension == "parquet" and info.path not in self.bounds and info.path.rsplit("/", 2)[0] in whole:
                meta = pq.ParquetFile(system.open_input_file(info.path)).metadata
                column = next(k for k in range(meta.num_columns) if meta.schema.column(k).name == self.number)
                told = [s for g in range(meta.num_row_groups) if (s := meta.row_group(g).column(column).statistics) is not None and s.has_min_max]
                self.bounds[info.path] = (min(s.min for s in told), max(s.max for s in told)) if told else None
        return self.bounds

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max((b[1] + 1 for b in self._known().values() if b), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Arrived]:
        buckets: dict[str, list[str]] = {}
        for path, bounds in self._known().items():
            if bounds and bounds[0] < end["next"] and bounds[1] >= start["next"]:
                buckets.setdefault(path.rsplit("/", 2)[1], []).append(path)
        return [Arrived(sorted(paths), start["next"], end["next"]) for paths in buckets.values()] or [Arrived([], 0, 0)]

    def read(self, partition: Arrived) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        kept: dict = {}
        for path in partition.paths:
            for batch in pq.ParquetFile(system.open_input_file(path)).iter_batches(4096, columns=self.schema.names):
                number = batch.column(self.number).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((number >= partition.start) & (number < partition.end)))
                if not batch.num_rows:
                    continue
                if self.admit == "all":
                    yield pa.RecordBatch.from_arrays([batch.column(n).cast(self.schema.field(n).type) for n in self.schema.names], schema=self.schema)
                    continue
                # the last of each key in the batch; one row for each key stays
                best: dict = {}
                for row, (key, at) in enumerate(zip(batch.column(self.key).to_pylist(), batch.column(self.number).to_pylist())):
                    if key not in best or at > best[key][1]:
                        best[key] = row, at
                for key, (row, at) in best.items():
                    if key not in kept or at > kept[key][1]:
                        kept[key] = batch.slice(row, 1), at
        if kept:
            rows = pa.Table.from_batches([batch for batch, _ in kept.values()]).combine_chunks().cast(self.schema)
            yield from rows.to_batches()

    def commit(self, end: dict) -> None:
        """Files stay: they belong to whoever wrote them."""


def arrivals(spark: SparkSession, path: str, schema: StructType | str, number: str, key: str, admit: str = "all") -> DataFrame:
    """The stream of the frames that arrive at path."""
    register(spark, FrameArrivals)
    return spark.readStream.format("frame_arrivals").schema(schema).options(number=number, key=key, admit=admit).load(path)


def slice_of(number: str, end: int, slices: int) -> Column:
    """Which of so many slices of the numbers from 0 up to end, that one aside, a number lies in."""
    out = F.lit(0)
    for k in range(1, slices):
        out = F.when(F.col(number) >= end * k // slices, k).otherwise(out)
    return out.cast("long")


def read_up_to(query: StreamingQuery, end: int) -> None:
    """Waits until a batch that ends at this offset is done. processAllAvailable() alone may come back before, when the source was looked at just ahead of what was added."""
    while True:
        query.processAllAvailable()
        if (failed := query.exception()) is not None:
            raise failed
        if not query.isActive:
            raise RuntimeError(f"the stream has ended before it read up to {end}")
        last = query.lastProgress
        done = [source["endOffset"]["next"] for source in json.loads(last.json)["sources"] if source["endOffset"]] if last else []
        if max(done, default=0) >= end:
            return
        time.sleep(0.05)


def delivered(rows: DataFrame, number: str, key: str, admit: str, write: Callable[[DataFrame], DataStreamWriter], slices: int = 3) -> int:
    """Lets rows arrive in so many slices of their numbers, each a batch of the stream that ``write`` makes a writer of; ends when all of it is done. Gives where the numbers end."""
    spark = rows.sparkSession
    path, rows = scratch(spark, "arrivals"), staged(rows)
    end = rows.agg(F.max(number)).first()[0]
    end = 0 if end is None else end + 1
    last = dict(rows.groupBy(slice_of(number, end, slices)).agg(F.max(number)).collect())  # a row a slice
    query = write(arrivals(spark, path, rows.schema, number, key, admit)).start()
    try:
        for k in range(slices):
            append_arrivals(rows.filter(slice_of(number, end, slices) == k), path, key)
            if k in last:
                read_up_to(query, last[k] + 1)
    finally:
        query.stop()
    return end
