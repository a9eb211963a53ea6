"""Frames as files: gzipped raw photos and PNG pictures, and what archives hold. One task writes whole files, a file a row.

Files are made in tasks and stay columns until a sink writes them: as rows of Parquet, or as files of a folder (commit.py), all or none in either case.
What reads them back takes Spark's binaryFile rows (path, length, content).
"""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Fixed value: a raw photo of this many bytes is an old one and isn't compressed.
OLD_RAW_BYTES = 1920 * 1080 * 3 // 2


@F.arrow_udf(BinaryType())
def gzipped(y: pa.Array, u: pa.Array, v: pa.Array) -> pa.Array:
    """A raw photo: luma, then both chroma planes, compressed; the same bytes for the same planes."""
    return pa.array([None if None in parts else gzip.compress(b"".join(parts), mtime=0) for parts in zip(y.to_pylist(), u.to_pylist(), v.to_pylist())], pa.binary())


@F.arrow_udf(BinaryType())
def _gunzipped(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else gzip.decompress(x) for x in data.to_pylist()], pa.binary())


def raw_bytes(content: Column, length: Column) -> Column:
    """The planes' bytes of a raw photo's file: as they are if its length is that of an old one, else decompressed."""
    old = length == OLD_RAW_BYTES
    return F.when(old, content).otherwise(_gunzipped(F.when(~old, content)))


def png(width: int, height: int, rgb: bytes) -> bytes:
    """A picture of 8-bit red, green and blue, each row unfiltered."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.frombuffer(rgb, np.uint8).reshape(height, 3 * width)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, rgb) of a picture that png() made; ValueError if it is another kind or damaged."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, size = 8, b"", None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum doesn't hold")
        if kind == b"IHDR":
            *size, depth, colour, _, _, lace = struct.unpack(">2I5B", part)
            if (depth, colour, lace) != (8, 2, 0):
                raise ValueError("not 8-bit red, green and blue, row by row")
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    width, height = size
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 3 * width)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return width, height, lines[:, 1:].tobytes()


def png_files(frames: DataFrame, rgb: str = "rgb") -> DataFrame:
    """frames (…, width, height, rgb) with ``content``, the picture's file, in place of rgb."""

    @F.arrow_udf(BinaryType())
    def made(width: pa.Array, height: pa.Array, data: pa.Array) -> pa.Array:
        return pa.array([png(*x) for x in zip(width.to_pylist(), height.to_pylist(), data.to_pylist())], pa.binary())

    return frames.withColumn("content", made("width", "height", rgb)).drop(rgb)


def png_frames(files: DataFrame, key: str) -> DataFrame:
    """(key, width, height, rgb) of files with (key, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png_pixels(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], [key, "width", "height", "rgb"])

    return files.select(key, "content").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, width int, height int, rgb binary")


def sample_factor(width: int, height: int, to_width: int, to_height: int) -> int:
    """The least power of two by which a picture is no larger than the target in either way; numbers.downsample_factor() for one size."""
    return 1 << max(0, (max(-(-width // to_width), -(-height // to_height)) - 1).bit_length())


def png_sampled(files: DataFrame, key: str, to_width: int, to_height: int) -> DataFrame:
    """(key, width, height, rgb) of pictures as they are decoded for a smaller target: every so manieth pixel of every so manieth row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                width, height, rgb = png_pixels(data)
                f = sample_factor(width, height, to_width, to_height)
                own = np.frombuffer(rgb, np.uint8).reshape(height, width, 3)[::f, ::f]
                rows.append((own.shape[1], own.shape[0], own.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], [key, "width", "height", "rgb"])

    return files.select(key, "content").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, width int, height int, rgb binary")


def zip_entries(archives: DataFrame, key: str) -> DataFrame:
    """(key, place, name, content): what archives hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                with zipfile.ZipFile(io.BytesIO(batch.column(1)[row].as_py())) as archive:
                    names = archive.namelist()
                    data = [archive.read(n) for n in names]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(names), pa.int64())), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string()), pa.array(data, pa.binary())], [key, "place", "name", "content"])

    return archives.select(key, "content").mapInArrow(run, f"{key} {archives.schema[key].dataType.simpleString()}, place int, name string, content binary")
