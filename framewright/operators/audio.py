"""Audio samples as rows (stream, idx, s): down-mix, resampling, offsets, trimming and 16-bit bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources.frames import byte_values, unsigned

RATE = 44_100
# What a recording skips at its start, and where it ends.
SKIP_SAMPLES, MOST_SECONDS = 2205, 120


def toward_zero(x: Column, by: Column | int) -> Column:
    """Integer division toward zero."""
    return (F.signum(x) * F.floor(F.abs(x) / by)).cast("long")


def downmix(samples: DataFrame, channels: int) -> DataFrame:
    """(stream, idx, s) from interleaved samples: the mean of each frame's channels, toward zero. A short last frame is left out."""
    own = samples.groupBy("stream", F.floor(F.col("idx") / channels).alias("idx")).agg(F.sum("s").alias("t"), F.count(F.lit(1)).alias("n"))
    return own.filter(F.col("n") == channels).select("stream", "idx", toward_zero(F.col("t"), channels).alias("s"))


def resample(samples: DataFrame, rate: int, to: int = RATE, chunk: int = 100) -> DataFrame:
    """(stream, idx, s) at another rate: linear between neighbours, starting anew in each chunk, as decoders hand chunks out.

    Output i of a chunk lies at i * rate / to of its input. A sample knows which outputs lie from it to its successor, so there is one
    window for the successor and no join.
    """
    piece = Window.partitionBy("stream", "chunk").orderBy("at")
    own = samples.withColumns({"chunk": F.floor(F.col("idx") / chunk), "at": F.pmod("idx", F.lit(chunk)).cast("long")})
    own = own.withColumns({"next": F.coalesce(F.lead("s").over(piece), F.col("s")), "n": F.count(F.lit(1)).over(Window.partitionBy("stream", "chunk"))})
    n_out = F.greatest(F.lit(1), F.floor((F.col("n") * (2 * to) + rate) / (2 * rate))).cast("long")
    # outputs i with floor(i * rate / to) = at; the last sample also has what lies beyond it
    first = F.ceil(F.col("at") * to / rate)
    end = F.when(F.col("at") == F.col("n") - 1, n_out - 1).otherwise(F.least(n_out - 1, F.ceil((F.col("at") + 1) * to / rate) - 1)).cast("long")
    each = own.filter(first <= end).withColumn("i", F.explode(F.sequence(first.cast("long"), end)))
    over = F.col("i") * rate - F.col("at") * to  # the share of the successor, over to
    value = F.floor((F.col("s") * (to - over) + F.col("next") * over) * 2 / (2 * to) + F.lit(0.5)).cast("long")
    return each.select("stream", "chunk", "i", F.greatest(F.lit(-32768), F.least(F.lit(32767), value)).cast("long").alias("s"))


def from_offset(samples: DataFrame, ms: int, rate: int = RATE) -> DataFrame:
    """The samples from a time on."""
    return samples.filter(F.col("idx") >= rate * ms // 1000)


def trimmed(samples: DataFrame, rate: int = RATE) -> DataFrame:
    """A recording without its first 4410 bytes, ended after two minutes."""
    own = samples.filter((F.col("idx") >= SKIP_SAMPLES) & (F.col("idx") < SKIP_SAMPLES + MOST_SECONDS * rate))
    return own.withColumn("idx", F.col("idx") - SKIP_SAMPLES)


def start_offset(audio_us: Column, video_us: Column) -> Column:
    """Milliseconds by which sound starts after the picture, 0 where either is missing."""
    late = F.floor(F.greatest(F.lit(0), audio_us - video_us) / 1000)
    return F.when((audio_us >= 0) & (video_us >= 0), late).otherwise(0).cast("long")


def page_seconds(n_bytes: Column, rate: int = RATE) -> Column:
    return n_bytes / 2 / rate


@F.arrow_udf(BinaryType())
def pcm_bytes(values: pa.Array) -> pa.Array:
    """Arrays of samples as 16-bit little-endian bytes."""
    flat, ends = np.asarray(values.flatten()).astype("<i2").tobytes(), 2 * np.cumsum(np.asarray(values.value_lengths().fill_null(0)))
    return pa.array([flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.binary())


def decode_pcm(raw: DataFrame, data: str = "raw") -> DataFrame:
    """(…, idx, s): the 16-bit little-endian samples of bytes. An odd last byte is left out."""
    rest = [c for c in raw.columns if c != data]
    n = F.floor(F.length(data) / 2).cast("int")
    own = raw.select(*rest, byte_values(data).alias("b"), F.when(n > 0, F.sequence(F.lit(0), n - 1)).alias("places"))
    each = own.select(*rest, "b", F.explode("places").alias("idx"))
    return each.select(*rest, "idx", (unsigned(F.get("b", F.col("idx") * 2)) + F.get("b", F.col("idx") * 2 + 1).cast("int") * 256).alias("s"))


def encode_pcm(samples: DataFrame) -> DataFrame:
    """(stream, raw): samples in order as 16-bit little-endian bytes."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "s"))), lambda r: r["s"])
    return samples.groupBy("stream").agg(parts.alias("s")).select("stream", pcm_bytes("s").alias("raw"))


def as_stereo_floats(samples: DataFrame) -> DataFrame:
    """left and right: each sample on both channels, from -1 to 1."""
    value = F.col("s") / 32768.0
    return samples.withColumns({"left": value, "right": value})
