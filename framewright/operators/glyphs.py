"""Character cells: block means, glyph choice, text and HTML exports, glyph stamping and falling drops.

A frame's blocks are groups within the frame, so their means need no shuffle beyond the one by frame; exports group cells by
row of characters first and rows by frame second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import char_index, clamp, css_hex, primary, yuv_to_rgb

# Fixed values of falling drops.
DROP_LENGTH, TICK_MS, DECAY_MS = 15, 200, 2000
DROP_TTL = DROP_LENGTH * TICK_MS + DECAY_MS


@dataclass(frozen=True)
class Grid:
    columns: int
    rows: int
    portrait: bool = False


def cell_place(grid: Grid, width: int, height: int) -> tuple[Column, Column, Column]:
    """(row, column, whether the pixel lies in a cell): blocks of whole pixels; what is left over at the far border is in none."""
    if grid.portrait:
        across, down = height // grid.columns, width // grid.rows
        row, at = F.floor(F.col("x") / down), F.floor(F.col("y") / across)
        return row.cast("int"), (grid.columns - 1 - at).cast("int"), (row < grid.rows) & (at < grid.columns)
    across, down = width // grid.columns, height // grid.rows
    row, at = F.floor(F.col("y") / down), F.floor(F.col("x") / across)
    return row.cast("int"), at.cast("int"), (row < grid.rows) & (at < grid.columns)


def cell_means(px: DataFrame, grid: Grid, width: int, height: int, colours: bool = False) -> DataFrame:
    """(frame_id, row, col, luma and, with colours, r, g, b): means over each cell, rounded down."""
    row, at, inside = cell_place(grid, width, height)
    values = ["yy"]
    if colours:
        px = px.withColumns(dict(zip("rgb", yuv_to_rgb("yy", "uu", "vv", "glyph_fixed"))))
        values += ["r", "g", "b"]
    means = [F.floor(F.sum(v) / F.count(F.lit(1))).cast("int").alias("luma" if v == "yy" else v) for v in values]
    return px.filter(inside).groupBy("frame_id", row.alias("row"), at.alias("col")).agg(*means)


def cells(px: DataFrame, grid: Grid, width: int, height: int, n_chars: int, mode: str = "fixed", text: tuple[int, int, int] = (0, 0, 0), scale: int = 255) -> DataFrame:
    """(frame_id, row, col, idx, r, g, b): each cell's character and colour; mode is fixed, primary or full."""
    if mode not in ("fixed", "primary", "full"):
        raise ValueError(f"unknown colour mode {mode!r}")
    means = cell_means(px, grid, width, height, mode != "fixed")
    own = tuple(F.col(c) for c in "rgb")
    colour = [F.lit(c) for c in text] if mode == "fixed" else primary(*own) if mode == "primary" else own
    return means.select("frame_id", "row", "col", char_index("luma", n_chars, scale).alias("idx"), *[c.cast("int").alias(n) for c, n in zip(colour, "rgb")])


def _ordered(rows: str, value: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda s: s[value]), rows)


def with_chars(grid_cells: DataFrame, chars: str) -> DataFrame:
    return grid_cells.withColumn("ch", F.substring(F.lit(chars), F.col("idx") + 1, F.lit(1)))


def text_rows(grid_cells: DataFrame, chars: str) -> DataFrame:
    """(frame_id, row, line): the characters of each row."""
    return with_chars(grid_cells, chars).groupBy("frame_id", "row").agg(_ordered("", "ch", "col").alias("line"))


def text_pages(grid_cells: DataFrame, chars: str) -> DataFrame:
    """(frame_id, page): the text export, each row with a line feed."""
    rows = text_rows(grid_cells, chars).withColumn("line", F.concat("line", F.lit("\n")))
    return rows.groupBy("frame_id").agg(_ordered("", "line", "row").alias("page"))


def colour_runs(grid_cells: DataFrame, chars: str) -> DataFrame:
    """(frame_id, row, first, colour, chars): runs of one colour in each row, left to right."""
    own = with_chars(grid_cells, chars).withColumn("colour", css_hex(*[F.col(c) for c in "rgb"]))
    order = Window.partitionBy("frame_id", "row").orderBy("col")
    new = F.when(F.lag("colour").over(order).eqNullSafe(F.col("colour")), 0).otherwise(1)
    own = own.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    return own.groupBy("frame_id", "row", "__run", "colour").agg(F.min("col").alias("first"), _ordered("", "ch", "col").alias("chars")).drop("__run")


# How a run of one colour and a row stand in the HTML export.
RUN, ROW = ("<i style=color:", ">", "</i>"), ("<pre>", "</pre>")
#: A page of our own around the rows: its look in one rule each, no more.
PAGE_HEAD = "<!DOCTYPE html><meta charset=utf-8><title>{title}</title><body style=background:{background}><style>i{{font-style:normal}}pre{{margin:0}}</style>"
PAGE_END = "</body>"


def html_rows(grid_cells: DataFrame, chars: str) -> DataFrame:
    """(frame_id, row, html): a row of the HTML export, an element for each run of one colour."""
    run = F.concat(F.lit(RUN[0]), "colour", F.lit(RUN[1]), "chars", F.lit(RUN[2]))
    runs = colour_runs(grid_cells, chars).withColumn("html", run)
    return runs.groupBy("frame_id", "row").agg(F.concat(F.lit(ROW[0]), _ordered("", "html", "first"), F.lit(ROW[1])).alias("html"))


def html_pages(grid_cells: DataFrame, chars: str, title: str, background: str = "#000000") -> DataFrame:
    """(frame_id, page): the whole HTML export."""
    rows = html_rows(grid_cells, chars).groupBy("frame_id").agg(_ordered("\n", "html", "row").alias("body"))
    return rows.select("frame_id", F.concat(F.lit(PAGE_HEAD.format(title=title, background=background)), "body", F.lit(PAGE_END)).alias("page"))


def block_glyphs(spark, n_chars: int, cell_w: int, cell_h: int) -> DataFrame:
    """(idx, gx, gy): the pixels that are on in our own glyphs: character k fills k/(n-1) of its cell, from the bottom up.

    The reference of glyph shapes is a font; there is none here, so the shapes are our own contract.
    """
    rows = [(k, x, y) for k in range(n_chars) for y in range(cell_h) for x in range(cell_w) if (cell_h - y) * (n_chars - 1) <= k * cell_h]
    return spark.createDataFrame(rows, "idx int, gx int, gy int")


def stamp(grid_cells: DataFrame, glyphs: DataFrame, cell_w: int, cell_h: int) -> DataFrame:
    """(frame_id, x, y, r, g, b) of the pixels that glyphs turn on. glyphs is a font, a small table whose size Spark knows and broadcasts by."""
    on = grid_cells.join(glyphs, "idx")
    return on.select("frame_id", (F.col("col") * cell_w + F.col("gx")).alias("x"), (F.col("row") * cell_h + F.col("gy")).alias("y"), "r", "g", "b")


def rain_base(means: DataFrame, text: tuple[int, int, int] = (0, 255, 0)) -> DataFrame:
    """(frame_id, row, col, r, g, b): a cell's colour by its luma."""
    return means.select("frame_id", "row", "col", *[F.floor(F.col("luma") * c / 255).cast("int").alias(n) for c, n in zip(text, "rgb")])


def cell_edges(means: DataFrame, grid: Grid, multiplier: int = 4) -> DataFrame:
    """means with luma replaced by the edge strength on the grid of cells."""
    row, at = Window.partitionBy("frame_id", "row").orderBy("col").rowsBetween(-1, 1), Window.partitionBy("frame_id", "col").orderBy("row").rowsBetween(-1, 1)
    summed = means.withColumn("__h", F.sum("luma").over(row)).withColumn("__s", F.sum("__h").over(at))
    inner = F.col("row").between(1, grid.rows - 2) & F.col("col").between(1, grid.columns - 2)
    return summed.withColumn("luma", F.when(inner, clamp((F.col("luma") * 9 - F.col("__s")) * multiplier)).otherwise(0).cast("int")).drop("__h", "__s")


def drop_cells(drops: DataFrame, n_rows: int, text: tuple[int, int, int] = (0, 255, 0)) -> DataFrame:
    """(frame_id, row, col, r, g, b, head): the cells that drops light; where several meet, that of the latest, then rightmost, then lowest.

    Takes (frame_id, ts_ms, x, y, start_ms, y_flipped). Drops that have not begun or have ended light nothing.
    """
    age = F.col("ts_ms") - F.col("start_ms")
    own = drops.withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") <= DROP_TTL))
    own = own.withColumn("ticks", F.floor(F.col("age") / TICK_MS).cast("int")).withColumn("dy", F.explode(F.sequence(F.lit(0), F.least(F.lit(DROP_LENGTH), F.col("ticks")))))
    own = own.withColumn("row", (F.col("y") + F.when(F.col("y_flipped"), -F.col("dy")).otherwise(F.col("dy"))).cast("int")).filter(F.col("row").between(0, n_rows - 1))
    left = F.lit(DROP_TTL) - (F.col("age") - F.col("dy") * TICK_MS)
    own = own.withColumn("left", F.least(left, F.lit(DROP_TTL))).withColumn("head", F.col("dy") == F.col("ticks")).filter("left > 0")
    colour = {n: F.when(F.col("head"), 255).otherwise(F.floor(F.col("left") * c / DROP_TTL)).cast("int") for n, c in zip("rgb", text)}
    lit = own.withColumns(colour).groupBy("frame_id", "row", F.col("x").alias("col"))
    best = lit.agg(F.max_by(F.struct("r", "g", "b", "head"), F.struct("start_ms", F.col("x"), F.col("y"), "dy")).alias("s"))
    return best.select("frame_id", "row", "col", "s.*")


def rain_over(base: DataFrame, drops: DataFrame) -> DataFrame:
    """(frame_id, row, col, r, g, b): base's cells, with the drops' colours where these light one."""
    lit = drops.select("frame_id", "row", "col", *[F.col(c).alias(f"drop_{c}") for c in "rgb"])
    return base.join(lit, ["frame_id", "row", "col"], "left").select("frame_id", "row", "col", *[F.coalesce(f"drop_{c}", c).alias(c) for c in "rgb"])
