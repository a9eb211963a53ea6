"""Queries of character cells, exports and falling drops, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glyphs as L
from ..session import table
from ..sources import frames as R
from .common import EV, PX, big, edge_cte, rgb_cte, whole

W, H = R.EVENT_W, R.EVENT_H
GRID, TALL = L.Grid(10, 5), L.Grid(5, 10, True)
CHARS = " .:oO8#"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: whole(f(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


GLYPH_RGB = rgb_cte(k=(359, 183, 88, 454))
MEANS = 'mn AS (SELECT frame_id, y // 5 AS "row", x // 4 AS col, sum(yy) // count(*) AS luma, sum(r) // count(*) AS r, sum(g) // count(*) AS g, sum(b) // count(*) AS b FROM rgb GROUP BY ALL)'
_idx = "CAST(least(6, luma * 7 // 255) AS BIGINT) AS idx"
FULL = f'full_ AS (SELECT frame_id, "row", col, {_idx}, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM mn)'
PRIMARY = f'prim AS (SELECT frame_id, "row", col, {_idx}, {", ".join(f"CASE WHEN {c} >= greatest(r, g, b) * 7 // 8 THEN 255 ELSE 0 END AS {c}" for c in "rgb")} FROM mn)'
BASE = f"WITH {PX}, {GLYPH_RGB}, {MEANS}"


@query("ascii_cells_fixed", f'WITH {EV} SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, {_idx}, 1::BIGINT AS r, 2::BIGINT AS g, 3::BIGINT AS b FROM (SELECT frame_id, x // 4 AS "row", 4 - y // 5 AS col, sum(yy) // count(*) AS luma FROM ev GROUP BY ALL)')
def ascii_cells_fixed(spark, sf):
    return L.cells(R.event_pixels(spark, sf), TALL, W, H, len(CHARS), "fixed", (1, 2, 3))


@query("ascii_cells_portrait", f'WITH {PX}, {GLYPH_RGB}, {MEANS.replace("y // 5 AS", "x // 4 AS").replace("x // 4 AS col", "4 - y // 5 AS col")}, {FULL} SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, idx, r, g, b FROM full_')
def ascii_cells_portrait(spark, sf):
    """Cells of a frame that is held upright: rows of characters run along x, and columns back along y."""
    return L.cells(R.event_pixels(spark, sf), TALL, W, H, len(CHARS), "full")


@query("ascii_cells_full", f'{BASE}, {FULL} SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, idx, r, g, b FROM full_')
def ascii_cells_full(spark, sf):
    return L.cells(R.event_pixels(spark, sf), GRID, W, H, len(CHARS), "full")


@query("ascii_cells_primary", f'{BASE}, {PRIMARY} SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, idx, {big("r g b")} FROM prim')
def ascii_cells_primary(spark, sf):
    return L.cells(R.event_pixels(spark, sf), GRID, W, H, len(CHARS), "primary")


@query("ascii_text", f"""{BASE}, ln AS (SELECT frame_id, "row", string_agg(substr('{CHARS}', CAST(luma * 7 // 256 AS INTEGER) + 1, 1), '' ORDER BY col) AS line FROM mn GROUP BY ALL)
SELECT CAST(frame_id AS BIGINT) AS frame_id, string_agg(line || chr(10), '' ORDER BY "row") AS page FROM ln GROUP BY frame_id""")
def ascii_text(spark, sf):
    return L.text_pages(L.cells(R.event_pixels(spark, sf), GRID, W, H, len(CHARS), "fixed", scale=256), CHARS)


@query("ascii_html_runs", f"""{BASE}, {PRIMARY}, c AS (SELECT *, lower(printf('#%06X', CAST(r * 65536 + g * 256 + b AS BIGINT))) AS colour, substr('{CHARS}', CAST(idx AS INTEGER) + 1, 1) AS ch FROM prim),
n AS (SELECT *, row_number() OVER (PARTITION BY frame_id, "row" ORDER BY col) - row_number() OVER (PARTITION BY frame_id, "row", colour ORDER BY col) AS island FROM c),
runs AS (SELECT frame_id, "row", colour, island, min(col) AS first, string_agg(ch, '' ORDER BY col) AS chars FROM n GROUP BY ALL)
SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST("row" AS BIGINT) AS "row", '<pre>' || string_agg('<i style=color:' || colour || '>' || chars || '</i>', '' ORDER BY first) || '</pre>' AS html FROM runs GROUP BY frame_id, "row\"""")
def ascii_html_runs(spark, sf):
    return L.html_rows(L.cells(R.event_pixels(spark, sf), GRID, W, H, len(CHARS), "primary"), CHARS)


@query("glyph_stamp", f"""{BASE}, {FULL}, gl AS (SELECT k AS idx, gx, gy FROM range(7) a(k), range(3) b(gx), range(6) c(gy) WHERE (6 - gy) * 6 <= k * 6)
SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST(col * 3 + gx AS BIGINT) AS x, CAST("row" * 6 + gy AS BIGINT) AS y, r, g, b FROM full_ JOIN gl USING (idx)""")
def glyph_stamp(spark, sf):
    own = L.cells(R.event_pixels(spark, sf), GRID, W, H, len(CHARS), "full")
    return L.stamp(own, L.block_glyphs(spark, len(CHARS), 3, 6), 3, 6)


@query("matrix_base", f'{BASE} SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, CAST(luma * 30 // 255 AS BIGINT) AS r, CAST(luma * 255 // 255 AS BIGINT) AS g, CAST(luma * 160 // 255 AS BIGINT) AS b FROM mn')
def matrix_base(spark, sf):
    return L.rain_base(L.cell_means(R.event_pixels(spark, sf), GRID, W, H), (30, 255, 160))


@query("matrix_edges", f'{BASE}, mc AS (SELECT frame_id, col AS x, "row" AS y, luma AS yy FROM mn), {edge_cte("mc", 10, 5, 4)} SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST(y AS BIGINT) AS "row", CAST(x AS BIGINT) AS col, CAST(e AS BIGINT) AS luma FROM edge')
def matrix_edges(spark, sf):
    return L.cell_edges(L.cell_means(R.event_pixels(spark, sf), GRID, W, H), GRID)


def drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, ts_ms, x, y, start_ms, y_flipped): each event is a drop seen at a moment after its start."""
    own = table(spark, sf_dir, "events")
    start = F.floor(F.col("event_id") / 50) * 40
    return own.select(F.floor(F.col("event_id") / 100).alias("frame_id"), (F.floor(F.col("event_id") / 100) * 80 + F.col("user_id") % 53 * 100).alias("ts_ms"), (F.col("event_id") * 7 % 12).cast("int").alias("x"), (F.col("event_id") / 10 % 9).cast("int").alias("y"), start.alias("start_ms"), (F.floor(F.col("event_id") / 100) % 2 == 1).alias("y_flipped"))


@query("raindrop_cells", """WITH d AS (SELECT event_id // 100 AS frame_id, event_id // 100 * 80 + user_id % 53 * 100 AS ts, event_id * 7 % 12 AS x, event_id // 10 % 9 AS y, event_id // 50 * 40 AS st, event_id // 100 % 2 = 1 AS flip FROM events),
e AS (SELECT *, ts - st AS age, (ts - st) // 200 AS ticks FROM d WHERE ts - st BETWEEN 0 AND 5000),
f AS (SELECT *, y + CASE WHEN flip THEN -dy ELSE dy END AS "row", least(5000, 5000 - (age - dy * 200)) AS lft FROM e, range(16) t(dy) WHERE dy <= ticks),
g AS (SELECT *, row_number() OVER (PARTITION BY frame_id, "row", x ORDER BY st DESC, y DESC, dy DESC) AS k FROM f WHERE "row" BETWEEN 0 AND 11 AND lft > 0)
SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST("row" AS BIGINT) AS "row", CAST(x AS BIGINT) AS col, CAST(CASE WHEN dy = ticks THEN 255 ELSE 0 END AS BIGINT) AS r, CAST(CASE WHEN dy = ticks THEN 255 ELSE lft * 255 // 5000 END AS BIGINT) AS g,
CAST(CASE WHEN dy = ticks THEN 255 ELSE 0 END AS BIGINT) AS b, dy = ticks AS head FROM g WHERE k = 1""")
def raindrop_cells(spark, sf):
    return L.drop_cells(drops(spark, sf), 12)


QUERIES["raindrop_cells_all"], ORACLES["raindrop_cells_all"] = QUERIES["raindrop_cells"], ORACLES["raindrop_cells"]  # an older name
