"""Stained-glass segments: seeds, nearest seed, segment colours and borders.

A pixel is never compared with all seeds: these lie in the cells of a grid, where each follows from its cell by arithmetic, so a
pixel works out those of its own cell and the eight around it in place. There is no join, and pixels stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import jitter
from ..functions.pixels import clamp, yuv_to_rgb
from .stencil import along_column, along_row


def seeds(spark: SparkSession, width: int, height: int, spacing: int) -> DataFrame:
    """(seg, cx, cy, sx, sy): a seed near the middle of each cell of the grid; segments are numbered by row."""
    columns, rows = (len(range(spacing // 2, n, spacing)) for n in (width, height))
    each = spark.range(columns * rows).select(F.col("id").cast("int").alias("seg"), (F.col("id") % columns).cast("int").alias("cx"), F.floor(F.col("id") / columns).cast("int").alias("cy"))
    most = spacing // 3
    return each.select("seg", "cx", "cy", clamp(F.col("cx") * spacing + spacing // 2 + jitter(F.col("seg"), 0, most), 0, width - 1).alias("sx"), clamp(F.col("cy") * spacing + spacing // 2 + jitter(F.col("seg"), 1, most), 0, height - 1).alias("sy"))


def nearest_seed(x: Column, y: Column, width: int, height: int, spacing: int) -> Column:
    """The segment of the nearest seed in the 3 x 3 cells around a pixel; the lowest of those that tie."""
    columns, rows, most = len(range(spacing // 2, width, spacing)), len(range(spacing // 2, height, spacing)), spacing // 3

    def seed(k: int) -> Column:
        cx, cy = (F.floor(x / spacing) + (k % 3 - 1)).cast("int"), (F.floor(y / spacing) + (k // 3 - 1)).cast("int")
        seg = cy * columns + cx
        off_x = x - clamp(cx * spacing + spacing // 2 + jitter(seg, 0, most), 0, width - 1)
        off_y = y - clamp(cy * spacing + spacing // 2 + jitter(seg, 1, most), 0, height - 1)
        there = cx.between(0, columns - 1) & cy.between(0, rows - 1)
        # distance and segment in one number: the nearest, and of those that tie the lowest
        return F.when(there, (off_x * off_x + off_y * off_y).cast("long") * (columns * rows) + seg)

    # nine terms and no lambda, which Spark would interpret for each pixel; nulls are passed over
    return F.pmod(F.least(*map(seed, range(9))), F.lit(columns * rows)).cast("int")


def assigned(px: DataFrame, width: int, height: int, spacing: int) -> DataFrame:
    """px with the segment of each pixel."""
    return px.withColumn("seg", nearest_seed(F.col("x"), F.col("y"), width, height, spacing))


def segment_colours(with_seg: DataFrame, variation: int = 12) -> DataFrame:
    """(frame_id, seg, n, r, g, b): each segment's mean colour, moved by a little."""
    rgb = with_seg.select("frame_id", "seg", *[c.alias(n) for c, n in zip(yuv_to_rgb("yy", "uu", "vv"), "rgb")])
    means = rgb.groupBy("frame_id", "seg").agg(F.count(F.lit(1)).alias("n"), *[F.floor(F.sum(c) / F.count(F.lit(1))).alias(c) for c in "rgb"])
    return means.select("frame_id", "seg", "n", *[moved(F.col(c), k, variation).alias(c) for k, c in enumerate("rgb")])


def moved(mean: Column, channel: int, variation: int) -> Column:
    """A segment's mean of a channel, moved by a little that follows from the segment."""
    return clamp(mean + jitter(F.col("seg"), 2 + channel, variation)).cast("int")


def segment_edges(with_seg: DataFrame, width: int, height: int, thickness: int) -> DataFrame:
    """(frame_id, x, y): the pixels of borders. One whose right neighbour is of another segment paints itself and those right of it,
    and likewise downward; the last row and column are not tested."""
    own = with_seg.withColumns({"right": F.lead("seg").over(along_row()), "below": F.lead("seg").over(along_column())}).filter((F.col("x") < width - 1) & (F.col("y") < height - 1))
    steps = F.sequence(F.lit(0), F.lit(thickness - 1))
    right = own.filter("right != seg").withColumn("t", F.explode(steps)).select("frame_id", (F.col("x") + F.col("t")).alias("x"), "y")
    below = own.filter("below != seg").withColumn("t", F.explode(steps)).select("frame_id", "x", (F.col("y") + F.col("t")).alias("y"))
    return right.filter(F.col("x") < width).unionByName(below.filter(F.col("y") < height)).distinct()


def stained_glass(px: DataFrame, width: int, height: int, spacing: int, thickness: int = 1, edge_colour: tuple[int, int, int] = (0, 0, 0), variation: int = 12) -> DataFrame:
    """(frame_id, x, y, r, g, b): the whole effect."""
    own = assigned(px, width, height, spacing)
    # a pixel looks back for what paints it, as far as a border is thick; all windows take the partitions of frames as they are
    inner = (F.col("x") < width - 1) & (F.col("y") < height - 1)
    for paints, line in (("__right", along_row()), ("__below", along_column())):
        own = own.withColumn(paints, inner & (F.max("seg").over(line.rangeBetween(1, 1)) != F.col("seg")))
        own = own.withColumn(paints, F.max(paints).over(line.rangeBetween(1 - thickness, 0)))
    segment = Window.partitionBy("frame_id", "seg")
    means = [F.floor(F.sum(c).over(segment) / F.count(F.lit(1)).over(segment)) for c in yuv_to_rgb("yy", "uu", "vv")]
    edge = F.coalesce("__right", F.lit(False)) | F.coalesce("__below", F.lit(False))
    return own.select("frame_id", "x", "y", *[F.when(edge, c).otherwise(moved(m, k, variation)).alias(n) for k, (c, m, n) in enumerate(zip(edge_colour, means, "rgb"))])


# Seeds in rows of different lengths: a row is a band of ``spacing`` lines, with any number of seeds anywhere in it


def numbered(seeds: DataFrame) -> DataFrame:
    """(frame_id, row, seg, sx, sy) of seeds (frame_id, row, k, sx, sy): segments are numbered row by row, so a row begins at the sum of the sizes of those before it."""
    # a frame has no more seeds than pixels
    return seeds.withColumn("seg", (F.row_number().over(Window.partitionBy("frame_id").orderBy("row", "k")) - 1).cast("int")).drop("k")


def nearest_of_rows(width: int, height: int, spacing: int, row: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """The nearest of a frame's seeds for each pixel, the first of those that tie; -1 if there is none. row is ascending, and sy lies in its row's band.

    Each pixel looks through its own row and then through rows farther and farther off, and within a row from its place in the order of sx to either side. It stops
    on a side when the difference in x alone, and in a direction when the distance to the row's band alone, is more than the best distance found; what lies
    beyond is farther in either case.
    """
    out, best = np.full(width * height, -1), np.full(width * height, np.iinfo(np.int64).max)
    if not len(row):
        return out.reshape(height, width)
    order = np.lexsort((sx, row))
    xs, ys, seg, stride = sx[order], sy[order], order, width + 1
    key = row[order] * stride + xs
    n_rows = -(-height // spacing)
    first = np.searchsorted(key, np.arange(n_rows + 1) * stride)  # of each row, by the sizes of those before it
    x, y = np.tile(np.arange(width), height), np.repeat(np.arange(height), width)

    def look(at: np.ndarray, of_row: np.ndarray, step: int) -> None:
        j = np.searchsorted(key, of_row * stride + x[at]) - (step < 0)
        while len(at):
            there = (j >= first[of_row]) & (j < first[of_row + 1])
            at, of_row, j = at[there], of_row[there], j[there]
            off = x[at] - xs[j]
            near = off * off <= best[at]
            at, of_row, j, off = at[near], of_row[near], j[near], off[near]
            d = off * off + (y[at] - ys[j]) ** 2
            better = (d < best[at]) | ((d == best[at]) & (seg[j] < out[at]))
            best[at[better]], out[at[better]] = d[better], seg[j[better]]
            j = j + step

    for off in range(n_rows):
        looked = False
        for sign in (1, -1) if off else (1,):
            of_row = y // spacing + sign * off
            gap = np.maximum(0, np.where(of_row * spacing > y, of_row * spacing - y, y - ((of_row + 1) * spacing - 1)))
            at = np.flatnonzero((of_row >= 0) & (of_row < n_rows) & (gap * gap <= best))
            looked |= len(at) > 0
            for step in (1, -1):
                look(at, of_row[at], step)
        if not looked:
            break
    return out.reshape(height, width)


def assigned_by_rows(px: DataFrame, seeds: DataFrame, width: int, height: int, spacing: int) -> DataFrame:
    """px with seg, that of the nearest of its frame's seeds numbered() so; null in a frame without seeds. A frame's seeds are one row beside it; no pixel meets all of them."""
    own = numbered(seeds).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("seg", "row", "sx", "sy"))).alias("s"))
    maps = px.select("frame_id").distinct().join(own, "frame_id", "left").select("frame_id", *[F.col(f"s.{c}").cast("array<int>").alias(c) for c in ("row", "sx", "sy")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, *seed in zip(*(c.to_pylist() for c in batch.columns)):
                found = nearest_of_rows(width, height, spacing, *(np.array(v or [], np.int64) for v in seed))
                at = np.arange(width * height)
                seg = pa.array(found.ravel(), pa.int32(), mask=found.ravel() < 0)
                yield pa.RecordBatch.from_arrays([pa.array([frame] * len(at), pa.int64()), pa.array(at % width, pa.int32()), pa.array(at // width, pa.int32()), seg], ["frame_id", "x", "y", "seg"])

    return px.join(maps.mapInArrow(run, "frame_id long, x int, y int, seg int"), ["frame_id", "x", "y"])
