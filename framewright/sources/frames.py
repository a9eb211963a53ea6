"""Frames as DataFrames, in two forms.

*Pixel form*: a row per pixel (frame_id, x, y, yy, uu, vv), for plain Spark SQL. *Plane form*: a row per frame
(frame_id, width, height, yp, up, vp) with binary planes, chroma at half size rounded up, for numpy kernels over Arrow.

A frame is bounded (some millions of pixels at most), a stream of frames is not. So pixel form is partitioned by frame_id once;
windows and groups within a frame then need no further shuffle.

The tables hold no pictures: the frames here are synthetic rasters of numbers in events and embeddings, inputs for operators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, LongType

from ..functions.pixels import col
from ..session import table

#: Size of event frames, and of embedding frames.
EVENT_W, EVENT_H = 40, 25
VEC_W, VEC_H = 64, 50
#: Milliseconds from one synthetic frame to the next.
FRAME_MS = 137


def frame_partitions(px: DataFrame) -> DataFrame:
    return px.repartition("frame_id")


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 1000 events each, in pixel form; every 2 x 2 block has the chroma of its first pixel."""
    frame = F.floor(F.col("event_id") / 1000)
    r = F.pmod(F.col("event_id"), F.lit(1000))
    luma = F.pmod(F.floor(F.col("value") * 100) + F.col("user_id") * 7, F.lit(256))
    own = table(spark, sf_dir, "events").select(
        frame.cast("long").alias("frame_id"),
        F.pmod(r, F.lit(EVENT_W)).cast("int").alias("x"),
        F.floor(r / EVENT_W).cast("int").alias("y"),
        luma.cast("int").alias("yy"),
        F.pmod(F.col("event_id") * 37 + F.col("user_id"), F.lit(256)).cast("int").alias("pu"),
        F.pmod(F.col("event_id") * 91 + F.col("user_id") * 5, F.lit(256)).cast("int").alias("pv"),
    )
    return shared_chroma(frame_partitions(own), "pu", "pv").drop("pu", "pv")


def shared_chroma(px: DataFrame, u: str, v: str) -> DataFrame:
    """Adds uu and vv: the values of u and v at the even pixel of each 2 x 2 block (the lookup of subsampled chroma)."""
    block = Window.partitionBy("frame_id", F.floor(F.col("y") / 2), F.floor(F.col("x") / 2))
    even = (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)
    return px.withColumns({out: F.max(F.when(even, F.col(c))).over(block) for out, c in (("uu", u), ("vv", v))})


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 50 embeddings each, in pixel form (luma only): x is the place in the vector, y its number in the frame."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    luma = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 127.5)))
    own = rows.select(F.floor(F.col("vec_id") / VEC_H).cast("long").alias("frame_id"), "x", F.pmod(F.col("vec_id"), F.lit(VEC_H)).cast("int").alias("y"), luma.cast("int").alias("yy"))
    return frame_partitions(own)


@F.arrow_udf(BinaryType())
def packed(values: pa.Array) -> pa.Array:
    """Arrays of numbers from 0 to 255 as binary."""
    flat, ends = np.asarray(values.flatten()).astype(np.uint8).tobytes(), np.cumsum(np.asarray(values.value_lengths().fill_null(0)))
    return pa.array([flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.binary())


@F.arrow_udf(ArrayType(ByteType()))
def byte_values(data: pa.Array) -> pa.Array:
    """Binary as arrays of its bytes, signed as Spark has them; unsigned() gives numbers from 0 to 255. The batch's own memory under another type, not a copy."""
    valid, offsets, own = data.cast(pa.binary()).buffers()
    values = pa.Array.from_buffers(pa.int8(), own.size if own else 0, [None, own or pa.py_buffer(b"")])
    return pa.Array.from_buffers(pa.list_(pa.int8()), len(data), [valid, offsets], offset=data.offset, children=[values])


def unsigned(value: Column | str) -> Column:
    return F.pmod(col(value).cast("int"), F.lit(256))


@F.arrow_udf(LongType())
def byte_sum(data: pa.Array) -> pa.Array:
    """The sum of a binary's bytes, without a number for each; 0 for null."""
    return pa.array([int(np.frombuffer(x.as_buffer(), np.uint8).sum(dtype=np.int64)) if x.is_valid else 0 for x in data], pa.int64())


def to_planes(px: DataFrame, width: int, height: int) -> DataFrame:
    """Pixel form to plane form. Frames with missing pixels are an error of the input and give short planes."""
    place = F.col("y") * width + F.col("x")
    even = (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)

    def plane(value: str, where: Column | None = None) -> Column:
        item = F.struct(place.alias("i"), F.col(value).alias("v"))
        rows = F.array_sort(F.collect_list(item if where is None else F.when(where, item)))
        return F.transform(rows, lambda r: r["v"])

    aggs = [plane("yy").alias("yp")]
    if {"uu", "vv"} <= set(px.columns):
        aggs += [plane("uu", even).alias("up"), plane("vv", even).alias("vp")]
    out = px.groupBy("frame_id").agg(*aggs)
    return out.select("frame_id", F.lit(width).alias("width"), F.lit(height).alias("height"), *[packed(c).alias(c) for c in out.columns[1:]])


def to_pixels(planes: DataFrame) -> DataFrame:
    """Plane form to pixel form.

    The outer form keeps Spark from asking beforehand, by another run of the bytes' Python step, whether a plane is empty; its rows without a place go.
    """
    own = planes.select("frame_id", "width", byte_values("yp").alias("y_"), byte_values("up").alias("u_"), byte_values("vp").alias("v_"))
    each = own.select("frame_id", "width", "u_", "v_", F.posexplode_outer("y_").alias("i", "yy")).filter("i IS NOT NULL")
    x, y = F.pmod(F.col("i"), F.col("width")), F.floor(F.col("i") / F.col("width")).cast("int")
    chroma = (F.floor(y / 2) * F.ceil(F.col("width") / 2) + F.floor(x / 2)).cast("int")
    return each.select("frame_id", x.alias("x"), y.alias("y"), unsigned("yy").alias("yy"), unsigned(F.get("u_", chroma)).alias("uu"), unsigned(F.get("v_", chroma)).alias("vv"))


def from_raw(raw: DataFrame, width: int, height: int, data: str = "raw") -> DataFrame:
    """Flattened frames (luma, then both chroma planes) to planes, by slices of the bytes."""
    half = -(-width // 2) * -(-height // 2)
    part = lambda at, n: F.substring(F.col(data), at + 1, n)
    return raw.withColumns({"width": F.lit(width), "height": F.lit(height), "yp": part(0, width * height), "up": part(width * height, half), "vp": part(width * height + half, half)}).drop(data)


def fixed_records(raw: DataFrame, record: int, data: str = "raw") -> DataFrame:
    """A row for each whole record of so many bytes: (…, index, raw). A short last record is left out, as it is no frame."""
    n = F.floor(F.length(data) / record).cast("int")
    each = raw.withColumn("index", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return each.withColumn(data, F.substring(F.col(data), F.col("index") * record + 1, F.lit(record)))


def without_strides(raw: DataFrame, width: int, row_stride: int, pixel_stride: int, data: str = "raw") -> DataFrame:
    """(…, x, y, value): the bytes of a plane that are pixels; padding and interleaved bytes go."""
    rest = [c for c in raw.columns if c != data]
    each = raw.select(*rest, F.posexplode(byte_values(data)).alias("at", "value")).withColumn("in_row", F.pmod("at", F.lit(row_stride)))
    each = each.filter((F.col("in_row") < width * pixel_stride) & (F.col("in_row") % pixel_stride == 0))
    return each.select(*rest, F.floor(F.col("in_row") / pixel_stride).cast("int").alias("x"), F.floor(F.col("at") / row_stride).cast("int").alias("y"), unsigned("value").alias("value"))
