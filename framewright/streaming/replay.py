"""Tables run through a stream to the end: what arrives in slices goes through a streaming transformation into a sink's table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .arrivals import delivered, slice_of


def run(rows: DataFrame, by: str, build: Callable[[DataFrame], DataFrame], slices: int = 3, key: str = "video") -> DataFrame:
    """What a streaming transformation makes of rows, which arrive by ``by`` (whole numbers from 0): the sink's table, after all slices were read."""
    spark, folder, schemas = rows.sparkSession, scratch(rows.sparkSession, "stream"), []

    def write(stream: DataFrame):
        made = build(stream)
        schemas.append(made.schema)
        return made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")

    delivered(rows, by, key, "all", write, slices)
    return spark.read.schema(schemas[0]).parquet(f"{folder}/out") if rows_written(spark, folder) else spark.createDataFrame([], schemas[0])


def rows_written(spark, folder: str) -> bool:
    """Whether a stream has committed a batch to its sink."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run_latest(rows: DataFrame, by: str, keys: list[str], slices: int = 3) -> DataFrame:
    """A slot that holds one frame for each key: of what arrives between two batches the source hands on the last row by ``by``; the others are lost.

    A batch is written to a folder of its own, in place of what an earlier try left there. ``batch`` is the slice it arrived in, which empty slices don't shift.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, "stream")

    def hand_on(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    (key,) = keys
    end = delivered(rows, by, key, "latest", lambda stream: stream.writeStream.foreachBatch(hand_on).option("checkpointLocation", f"{folder}/state"), slices)
    if not rows_written(spark, folder):
        return rows.limit(0).select(F.lit(0).cast("long").alias("batch"), *rows.columns)
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").select(slice_of(by, end, slices).alias("batch"), *rows.columns)
