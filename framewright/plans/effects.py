"""Queries of effects by name: all presets, a combination grid, and colour schemes on convolutions, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..effects import combination, effect, effect_pixels
from ..effects.presets import GLASS, OIL, glass, oil, presets
from ..effects.registry import Effect
from ..functions.pixels import edge_multiplier
from ..session import table
from ..sources import frames as R
from .common import PX, big, conv_cte, edge_cte, map_sql, rgb_cte
from .raster import TRUNC, blur_sql, glass_sql, oil_sql, real_sql, resize_sql, toon_cte

W, H = R.EVENT_W, R.EVENT_H
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Frames are small here: characters may be four pixels wide.
PREFS = {"minCharWidth": 4, "numColumns": 60}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _over(value: str, low, behind: tuple[str, str, str]) -> str:
    return ", ".join(f"({a} * (255 - {value}) + ({b}) * {value} + 127) // 255 AS {n}" for a, b, n in zip(low, behind, "rgb"))


def _between(share: str, first, last) -> tuple[str, ...]:
    return tuple(f"CAST(floor(({share}) * {b - a}e0 + {a}e0 + 0.5e0) AS BIGINT)" for a, b in zip(first, last))


def paint_sql(source: str, value: str, params: dict, w: int = W, h: int = H) -> str:
    """CTEs ending in ``done``: frame_id, x, y, r, g, b of a value under a colour scheme."""
    own = params.get("colors", params)
    kind, low = own.get("type"), own.get("minColor", (0, 0, 0))
    if kind == "linear_gradient":
        share = f"CAST(x * {w} + y * {h} AS DOUBLE) / {float(w * w + h * h)}e0"
        return f"done AS (SELECT frame_id, x, y, {_over(value, low, _between(share, own['gradientStartColor'], own['gradientEndColor']))} FROM {source})"
    if kind == "radial_gradient":
        share = f"sqrt(CAST((2 * x - {w}) * (2 * x - {w}) + (2 * y - {h}) * (2 * y - {h}) AS DOUBLE)) / {float(max(w, h))}e0"
        return f"far AS (SELECT *, {share} AS s0 FROM {source}), near AS (SELECT *, CASE WHEN s0 > 1 THEN 2e0 - s0 ELSE s0 END AS s FROM far), done AS (SELECT frame_id, x, y, {_over(value, low, _between('s', own['centerColor'], own['outerColor']))} FROM near)"
    if kind == "grid_gradient":
        grid, per = own["grid"], own.get("pixelsPerCell", 80)
        across, down = len(grid[0]), len(grid)
        phase = lambda speed, n: f"(frame_id * {R.FRAME_MS} * {speed} // 1000 % {n * 1000} * {n * per} * 2 + 1000) // 2000"
        window = [int(float(own.get(k, 1)) * per) for k in ("sizeX", "sizeY")]
        table_ = "[" + ", ".join("[" + ", ".join(map(str, cell)) + "]" for row in grid for cell in row) + "]"
        at = f"at_ AS (SELECT *, ({phase(own.get('speedX', 0), across)} + x * {window[0]} // {w}) % {across * per} AS bx, ({phase(own.get('speedY', 0), down)} + y * {window[1]} // {h}) % {down * per} AS by_ FROM {source})"
        cell = f"cell AS (SELECT *, list_extract({table_}, CAST(by_ // {per} * {across} + bx // {per} + 1 AS INTEGER)) AS c, bx % {per} AS fx, by_ % {per} AS fy FROM at_)"
        n = per - 1
        mixed = lambda k: f"((c[{k + 1}] * ({n} - fx) + c[{k + 4}] * fx) * ({n} - fy) + (c[{k + 7}] * ({n} - fx) + c[{k + 10}] * fx) * fy)"
        behind = tuple(f"({mixed(k)} * 2 + {n * n}) // {2 * n * n}" for k in range(3))
        return f"{at}, {cell}, done AS (SELECT frame_id, x, y, {_over(value, low, behind)} FROM cell)"
    return f"done AS (SELECT frame_id, x, y, {map_sql(value, low, own.get('maxColor', (255, 255, 255)))} FROM {source})"


def _cells(params: dict) -> tuple[int, int, int, int]:
    least = params.get("minCharWidth", 10)
    n = max(1, min(params["numColumns"], W // least))
    w = W // n
    h = min((w * 18 + 5) // 10, H)
    return n, H // h, w, h


def _means(n: int, rows: int, w: int, h: int) -> str:
    return f'mn AS (SELECT frame_id, y // {h} AS "row", x // {w} AS col, ' + ", ".join(f"sum({v}) // count(*) AS {v}" for v in ("yy", "r", "g", "b")) + f" FROM rgb WHERE x < {n * w} AND y < {rows * h} GROUP BY ALL)"


def effect_sql(e: Effect) -> str:
    """An effect on the event frames: frame_id, x, y, r, g, b."""
    p = e.params
    if e.name == "edge_luminance":
        body = f"{edge_cte('px', W, H, edge_multiplier(W))}, {rgb_cte('edge', 'done', y='e')}"
    elif e.name == "edge":
        body = f"{edge_cte('px', W, H, edge_multiplier(W))}, {paint_sql('edge', 'e', p)}"
    elif e.name == "solid_color":
        body = paint_sql("px", "yy", p)
    elif e.name == "convolve3x3":
        body = f"{conv_cte('px', p['coefficients'])}, {paint_sql('conv', 'conv', p)}"
    elif e.name == "permute_color":
        of = {"MIN": "0", "RED": "r", "GREEN": "g", "BLUE": "b", "MAX": "255"}
        flip = "fl AS (SELECT frame_id, x, y, yy, (256 - uu) % 256 AS uu, (256 - vv) % 256 AS vv FROM px), " if p["flipUV"] else ""
        body = f"{flip}{real_sql(TRUNC, False, 'fl' if flip else 'px')}, done AS (SELECT frame_id, x, y, {', '.join(f'{of[p[c]]} AS o_{c}' for c in ('red', 'green', 'blue'))} FROM rgb)"
        return f"WITH {PX}, {body} SELECT frame_id, x, y, o_red AS r, o_green AS g, o_blue AS b FROM done"
    elif e.name == "cartoon":
        body = f"{real_sql(TRUNC, False)}, {toon_cte()}, {blur_sql('toon', 'r g b', 4, W, H, 'done')}"
    elif e.name == "oil_painting":
        return f"SELECT frame_id, x, y, colour // 65536 AS r, colour // 256 % 256 AS g, colour % 256 AS b FROM ({oil_sql(p['brushSize'], p['levels'], p['contrastSensitivity'])})"
    elif e.name == "stained_glass":
        width = max(16, W // p["sectionsPerRow"])
        return glass_sql(width, max(1, int(p["edgeThickness"] * W + 0.5)), p["edgeColor"], int(255 * p["colorVariation"]))
    elif e.name == "matrix":
        n, rows, w, h = size = _cells(p)
        text = p["textColor"]
        value = "luma"
        body = f"{rgb_cte(k=(359, 183, 88, 454))}, {_means(*size)}, mc AS (SELECT frame_id, col AS x, \"row\" AS y, yy FROM mn)"
        if p["edges"]:
            body += f", {edge_cte('mc', n, rows, 4)}"
        value, source = ("e", "edge") if p["edges"] else ("yy", "mc")
        inks = ", ".join(f"{value} * {c} // 255 AS {k}" for c, k in zip((text >> 16 & 255, text >> 8 & 255, text & 255), "rgb"))
        body += f", done AS (SELECT frame_id, x * {w} + dx AS x, y * {h} + dy AS y, {inks} FROM {source}, range({w}) t1(dx), range({h}) t2(dy))"
    else:
        n, rows, w, h = size = _cells(p)
        chars, mode, colours = len(p["pixelChars"]), p["colorMode"], p.get("colors", {})
        text, back = colours.get("text", (255, 255, 255)), colours.get("background", (0, 0, 0))
        ink = {"fixed": text, "full": ("r", "g", "b"), "primary": tuple(f"CASE WHEN {c} >= greatest(r, g, b) * 7 // 8 THEN 255 ELSE 0 END" for c in "rgb")}[mode]
        on = f"({h} - dy) * {chars - 1} <= least({chars - 1}, yy * {chars} // 255) * {h}"
        inks = ", ".join(f"CASE WHEN {on} THEN {a} ELSE {b} END AS {k}" for a, b, k in zip(ink, back, "rgb"))
        body = f"{rgb_cte(k=(359, 183, 88, 454))}, {_means(*size)}, done AS (SELECT frame_id, col * {w} + dx AS x, \"row\" * {h} + dy AS y, {inks} FROM mn, range({w}) t1(dx), range({h}) t2(dy))"
    return f"WITH {PX}, {body} SELECT frame_id, x, y, r, g, b FROM done"


def event_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Event frames in plane form, with their times."""
    return R.to_planes(R.event_pixels(spark, sf), W, H).withColumn("ms", F.col("frame_id") * R.FRAME_MS)


def painted(spark: SparkSession, sf: str, kernels: dict) -> DataFrame:
    """(effect, frame_id, x, y, r, g, b)."""
    return effect_pixels(event_planes(spark, sf), kernels)


ALL = presets(PREFS)


def _numbered(parts: dict[int, str]) -> str:
    return " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS effect, {big('frame_id x y r g b')} FROM ({sql})" for k, sql in parts.items())


@query("preset_pixels", _numbered({k: effect_sql(e) for k, e in enumerate(ALL)}))
def preset_pixels(spark, sf):
    """Every preset on every frame."""
    return painted(spark, sf, {k: e.kernel for k, e in enumerate(ALL)})


_LOOKS = {"linear": {"type": "linear_gradient", "minEdgeColor": [10, 20, 30], "gradientStartColor": [0, 255, 0], "gradientEndColor": [0, 0, 255]}, "radial": {"type": "radial_gradient", "minColor": [25, 25, 112], "centerColor": [255, 255, 0], "outerColor": [255, 70, 0]},
          "fixed": {"type": "fixed", "minEdgeColor": [1, 2, 3], "maxEdgeColor": [250, 240, 230]}, "none": {}}
_SHARPEN = [0, -1, 0, -1, 5, -1, 0, -1, 0]
_KINDS = [effect(name, {**({"coefficients": _SHARPEN} if name == "convolve3x3" else {}), **({"colors": look} if k % 2 else look)}) for k, look in enumerate(_LOOKS.values()) for name in ("edge", "solid_color", "convolve3x3")]


def _renamed(params: dict) -> dict:
    """The parameters with the newer names of colours, which the SQL knows alone."""
    new = {"minEdgeColor": "minColor", "maxEdgeColor": "maxColor"}
    own = {new.get(k, k): v for k, v in params.get("colors", params).items()}
    return {**{k: v for k, v in params.items() if k == "coefficients"}, "colors": own}


@query("scheme_pixels", _numbered({k: effect_sql(Effect(e.name, _renamed(e.params), e.kernel)) for k, e in enumerate(_KINDS)}))
def scheme_pixels(spark, sf):
    """Edges, the picture and a convolution under each kind of colour scheme, with old and new names of colours."""
    return painted(spark, sf, {k: e.kernel for k, e in enumerate(_KINDS)})


_VARIANTS = [*map(oil, OIL), *map(glass, GLASS)]


@query("variant_pixels", _numbered({k: effect_sql(e) for k, e in enumerate(_VARIANTS)}))
def variant_pixels(spark, sf):
    """The named variants of oil paintings and of stained glass."""
    return painted(spark, sf, {k: e.kernel for k, e in enumerate(_VARIANTS)})


# A combination of four on the frame at a tile's size: chroma is resized as planes

TILE = (20, 12)
_HALF = f"cx AS (SELECT frame_id, x // 2 AS x, y // 2 AS y, pu AS uu, pv AS vv FROM ev WHERE x % 2 = 0 AND y % 2 = 0), {resize_sql('cx', 'uu', W // 2, -(-H // 2), TILE[0] // 2, TILE[1] // 2, 'su')}, {resize_sql('cx', 'vv', W // 2, -(-H // 2), TILE[0] // 2, TILE[1] // 2, 'sv')}"
SMALL = f"{PX}, {resize_sql('ev', 'yy', W, H, *TILE, 'sy')}, {_HALF}, sm AS (SELECT sy.*, su.uu, sv.vv FROM sy JOIN su ON su.frame_id = sy.frame_id AND su.x = sy.x // 2 AND su.y = sy.y // 2 JOIN sv ON sv.frame_id = sy.frame_id AND sv.x = sy.x // 2 AND sv.y = sy.y // 2)"
_FOUR = [effect("edge_luminance"), effect("solid_color", {"colors": {"type": "fixed", "minColor": [255, 255, 255], "maxColor": [0, 0, 0]}}), effect("permute_color", {"red": "GREEN", "green": "BLUE", "blue": "RED"}), effect("edge", {})]
_TILES = f"""t0 AS (SELECT 0 AS i, frame_id, x, y, r, g, b FROM tl), t1 AS (SELECT 1 AS i, frame_id, x, y, {map_sql('yy', (255, 255, 255), (0, 0, 0))} FROM sm), t2 AS (SELECT 2 AS i, frame_id, x, y, g AS r, b AS g, r AS b FROM rgb), t3 AS (SELECT 3 AS i, frame_id, x, y, {map_sql('e', (0, 0, 0), (255, 255, 255))} FROM edge)"""


@query("combination_grid", f"WITH {SMALL}, {edge_cte('sm', *TILE, 2)}, {rgb_cte('edge', 'tl', y='e')}, {real_sql(TRUNC, False, 'sm')}, {_TILES}, every AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3) "
       f"SELECT {big('frame_id')}, CAST((1 - i % 2) * {TILE[0]} + x AS BIGINT) AS x, CAST(i // 2 * {TILE[1]} + y AS BIGINT) AS y, {big('r g b')} FROM every")  # fmt: skip
def combination_grid(spark, sf):
    return painted(spark, sf, {0: combination(_FOUR, TILE, x_flipped=True)}).drop("effect")


@query("effect_metadata", f"SELECT event_id, list_extract({[e.name for e in ALL]}, CAST(event_id % {len(ALL)} + 1 AS INTEGER)) AS name, list_extract([{', '.join(chr(39) + e.metadata()['params'] + chr(39) for e in ALL)}], CAST(event_id % {len(ALL)} + 1 AS INTEGER)) AS params FROM events WHERE event_type IS NOT NULL")
def effect_metadata(spark, sf):
    """The metadata of the preset of each event, by a join with the table of presets."""
    rows = [(k, *e.metadata().values()) for k, e in enumerate(ALL)]
    known = spark.createDataFrame(rows, "k long, name string, params string")
    own = table(spark, sf, "events").filter("event_type IS NOT NULL").withColumn("k", F.pmod("event_id", F.lit(len(ALL))).cast("long"))
    return own.join(F.broadcast(known), "k").select("event_id", "name", "params")  # a row a preset
