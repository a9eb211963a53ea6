"""Queries of pixel operators in pixel form, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import pixels as P
from ..operators import geometry as G
from ..operators import segments as S
from ..operators import stencil as T
from ..session import table
from ..sources import frames as R
from .common import EV, PX, VEC, big, conv_cte, edge_cte, map_sql, near_sql, rgb_cte, whole

W, H = R.EVENT_W, R.EVENT_H
BLACK, WHITE = (0, 0, 0), (255, 255, 255)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: whole(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def at(df: DataFrame, **columns) -> DataFrame:
    return df.select("frame_id", "x", "y", *[c.alias(n) for n, c in columns.items()])


def rgb(cols) -> dict:
    return dict(zip("rgb", cols))


def with_rgb(px: DataFrame, variant: str = "fixed") -> DataFrame:
    return px.withColumns(rgb(P.yuv_to_rgb("yy", "uu", "vv", variant)))


# Edges

@query("edge_fixed", f"WITH {VEC}, {edge_cte('vec', 64, 50, 2)} SELECT {big('frame_id x y')}, {map_sql('e', BLACK, WHITE)} FROM edge")
def edge_fixed(spark, sf):
    px = T.edges(R.embedding_pixels(spark, sf), R.VEC_W, R.VEC_H)
    return at(px, **rgb(P.colour_map("edge", BLACK, WHITE)))


@query("edge_alpha", f"WITH {VEC}, {edge_cte('vec', 64, 50, 2)} SELECT {big('frame_id x y')}, CAST((255 - e) * 16777216 + 255 * 65536 + 70 * 256 AS BIGINT) AS argb FROM edge")
def edge_alpha(spark, sf):
    px = T.edges(R.embedding_pixels(spark, sf), R.VEC_W, R.VEC_H)
    return at(px, argb=P.alpha_map("edge", (255, 70, 0)))


@query("edge_luminance", f"WITH {PX}, {edge_cte('px', W, H, 2)}, {rgb_cte('edge', y='e')} SELECT {big('frame_id x y r g b')} FROM rgb")
def edge_luminance(spark, sf):
    px = T.edges(R.event_pixels(spark, sf), W, H)
    return at(px, **rgb(P.yuv_to_rgb("edge", "uu", "vv")))


# Solid colours and permutations

for _name, _low, _high in (("solid_fixed", (0, 0, 0), (0, 255, 160)), ("solid_negative", WHITE, BLACK)):
    @query(_name, f"WITH {EV} SELECT {big('frame_id x y')}, {map_sql('yy', _low, _high)} FROM ev")
    def solid(spark, sf, low=_low, high=_high):
        return at(R.event_pixels(spark, sf), **rgb(P.colour_map("yy", low, high)))

TRUNC = ("yy + 1.370705e0 * v", "yy - 0.698001e0 * v - 0.337633e0 * u", "yy + 1.732446e0 * u")
GLYPH = ("yy + 1.402e0 * v", "yy - 0.714136e0 * v - 0.344136e0 * u", "yy + 1.772e0 * u")
_uv = "uv AS (SELECT *, uu - 128 AS u, vv - 128 AS v FROM {0})"


def real_sql(exprs, rounded: bool, source: str = "px") -> str:
    half = " + 0.5e0" if rounded else ""
    each = ", ".join(f"CAST(floor(greatest(0e0, least(255e0, {'floor(' if rounded else ''}{e}{half}{')' if rounded else ''}))) AS BIGINT) AS {n}" for e, n in zip(exprs, "rgb"))
    return f"{_uv.format(source)}, rgb AS (SELECT frame_id, x, y, {each} FROM uv)"


for _name, _order, _flip in (("permute_gbr", ("GREEN", "BLUE", "RED"), False), ("permute_brg", ("BLUE", "RED", "GREEN"), False), ("permute_flip_uv", ("RED", "GREEN", "BLUE"), True), ("permute_min_max", ("MIN", "GREEN", "MAX"), False)):
    _of = {"RED": "r", "GREEN": "g", "BLUE": "b", "MIN": "0", "MAX": "255"}
    _cols = ", ".join(f"CAST({_of[s]} AS BIGINT) AS {n}" for s, n in zip(_order, ("o_r", "o_g", "o_b")))
    _src = "fl AS (SELECT frame_id, x, y, yy, (256 - uu) % 256 AS uu, (256 - vv) % 256 AS vv FROM px), " if _flip else ""

    @query(_name, f"WITH {PX}, {_src}{real_sql(TRUNC, False, 'fl' if _flip else 'px')} SELECT {big('frame_id x y')}, {_cols} FROM rgb")
    def permute(spark, sf, order=_order, flip=_flip):
        px = R.event_pixels(spark, sf)
        if flip:
            px = px.withColumns({"uu": P.flip_chroma("uu"), "vv": P.flip_chroma("vv")})
        px = with_rgb(px, "trunc")
        return at(px, **dict(zip(("o_r", "o_g", "o_b"), P.permute(F.col("r"), F.col("g"), F.col("b"), order))))


# Colour spaces

for _variant, _sql in (("fixed", rgb_cte()), ("glyph_fixed", rgb_cte(k=(359, 183, 88, 454))), ("trunc", real_sql(TRUNC, False)), ("round", real_sql(TRUNC, True)), ("glyph_round", real_sql(GLYPH, True))):
    @query(f"yuv_rgb_{_variant}", f"WITH {PX}, {_sql} SELECT {big('frame_id x y r g b')} FROM rgb")
    def yuv_rgb(spark, sf, variant=_variant):
        return with_rgb(R.event_pixels(spark, sf), variant).select("frame_id", "x", "y", "r", "g", "b")


_y = "(0.299e0 * r + 0.587e0 * g + 0.114e0 * b)"
_back = ", ".join(f"CAST(greatest(0, least(255, floor({e} + 0.5e0))) AS BIGINT) AS {n}" for e, n in ((_y, "y2"), (f"((b - {_y}) * 0.565e0 + 128)", "u2"), (f"((r - {_y}) * 0.713e0 + 128)", "v2")))


@query("rgb_to_yuv420", f"""WITH {PX}, {rgb_cte()}, back AS (SELECT frame_id, x, y, {_back} FROM rgb WHERE y < 24)
SELECT frame_id, x // 2 AS cx, y // 2 AS cy, CAST((2 + sum(u2)) // 4 AS BIGINT) AS u, CAST((2 + sum(v2)) // 4 AS BIGINT) AS v, CAST(sum(y2) AS BIGINT) AS luma FROM back GROUP BY ALL""")
def rgb_to_yuv420(spark, sf):
    px = with_rgb(R.event_pixels(spark, sf)).filter(F.col("y") < H // 2 * 2)  # even sizes only
    px = px.withColumns(dict(zip(("y2", "u2", "v2"), P.rgb_to_yuv("r", "g", "b"))))
    quarter = lambda c: F.floor((F.sum(c) + 2) / 4)
    return px.groupBy("frame_id", F.floor(F.col("x") / 2).alias("cx"), F.floor(F.col("y") / 2).alias("cy")).agg(quarter("u2").alias("u"), quarter("v2").alias("v"), F.sum("y2").alias("luma"))


@query("argb_pack", f"WITH {PX}, {rgb_cte()} SELECT {big('frame_id x y')}, CAST(4278190080 + r * 65536 + g * 256 + b AS BIGINT) AS argb, lower(printf('#%06X', r * 65536 + g * 256 + b)) AS css FROM rgb")
def argb_pack(spark, sf):
    px = with_rgb(R.event_pixels(spark, sf)).withColumn("argb", P.pack_argb(F.lit(255), F.col("r"), F.col("g"), F.col("b")))
    a, r, g, b = P.unpack_argb("argb")
    return px.filter(a == 255).select("frame_id", "x", "y", "argb", P.css_hex(r, g, b).alias("css"))


@query("primary_colours", f"WITH {PX}, {rgb_cte()}, m AS (SELECT *, greatest(r, g, b) * 7 // 8 AS t FROM rgb) SELECT {big('frame_id x y')}, " + ", ".join(f"CAST(CASE WHEN {c} >= t THEN 255 ELSE 0 END AS BIGINT) AS {c}" for c in "rgb") + " FROM m")
def primary_colours(spark, sf):
    px = with_rgb(R.event_pixels(spark, sf))
    return at(px, **rgb(P.primary(F.col("r"), F.col("g"), F.col("b"))))


@query("source_over", f"WITH {PX}, {rgb_cte()} SELECT {big('frame_id x y')}, " + ", ".join(f"CAST(({c} * yy + {k} * (255 - yy) + 127) // 255 AS BIGINT) AS {c}" for c, k in zip("rgb", (25, 25, 112))) + " FROM rgb")
def source_over(spark, sf):
    px = with_rgb(R.event_pixels(spark, sf))
    return at(px, **rgb(P.source_over((F.col("r"), F.col("g"), F.col("b")), F.col("yy"), (F.lit(25), F.lit(25), F.lit(112)))))


# Stencils

for _name, _kernel in T.KERNELS.items():
    @query(f"conv_{_name}", f"WITH {EV}, {conv_cte('ev', _kernel)} SELECT {big('frame_id x y')}, conv FROM conv")
    def conv(spark, sf, kernel=_kernel):
        return T.convolve3x3(R.event_pixels(spark, sf), kernel, out="conv").select("frame_id", "x", "y", "conv")


def blur_sql(source: str, values: str, r: int, w: int, h: int, name: str) -> str:
    sums = lambda: ", ".join(f"CAST(sum(b.{v}) // {2 * r + 1} AS BIGINT) AS {v}" for v in values.split())
    d = f"range(-{r}, {r + 1}) t(d)"
    return f"""{name}_h AS (SELECT a.frame_id, a.x, a.y, {sums()} FROM {source} a, {d} JOIN {source} b ON b.frame_id = a.frame_id AND b.y = a.y AND b.x = greatest(0, least({w - 1}, a.x + d)) GROUP BY ALL),
{name} AS (SELECT a.frame_id, a.x, a.y, {sums()} FROM {name}_h a, {d} JOIN {name}_h b ON b.frame_id = a.frame_id AND b.x = a.x AND b.y = greatest(0, least({h - 1}, a.y + d)) GROUP BY ALL)"""


@query("box_blur", f"WITH {EV}, {blur_sql('ev', 'yy', 2, W, H, 'blur')} SELECT {big('frame_id x y yy')} FROM blur")
def box_blur(spark, sf):
    return T.box_blur(R.event_pixels(spark, sf), ["yy"], 2, W, H).select("frame_id", "x", "y", "yy")


def toon_cte() -> str:
    level = lambda c: f"CASE WHEN {c} < 43 THEN 0 WHEN {c} < 128 THEN 85 WHEN {c} < 213 THEN 170 ELSE 255 END AS {c}"
    return f"toon AS (SELECT frame_id, x, y, {', '.join(map(level, 'rgb'))} FROM rgb)"


CARTOON_SQL = f"WITH {PX}, {real_sql(TRUNC, False)}, {toon_cte()}, {blur_sql('toon', 'r g b', 4, W, H, 'blur')} SELECT {big('frame_id x y r g b')} FROM blur"


def cartoon_pixels(px: DataFrame, radius: int = 4) -> DataFrame:
    px = with_rgb(px, "trunc").select("frame_id", "x", "y", *[P.quantise4(F.col(c)).alias(c) for c in "rgb"])
    return T.box_blur(px, ["r", "g", "b"], radius, W, H).select("frame_id", "x", "y", "r", "g", "b")


@query("cartoon", CARTOON_SQL)
def cartoon(spark, sf):
    return cartoon_pixels(R.event_pixels(spark, sf))


def resize_sql(source: str, value: str, w: int, h: int, nw: int, nh: int, name: str = "small") -> str:
    return f"""{name}_t AS (SELECT frame_id, tx.t AS x, ty.t AS y, tx.t * {w} // {nw} AS x1, ty.t * {h} // {nh} AS y1, tx.t * {w} % {nw} AS fx, ty.t * {h} % {nh} AS fy FROM (SELECT DISTINCT frame_id FROM {source}), range({nw}) tx(t), range({nh}) ty(t)),
{name} AS (SELECT t.frame_id, t.x, t.y, CAST((a.{value} * ({nw} - fx) * ({nh} - fy) + b.{value} * fx * ({nh} - fy) + c.{value} * ({nw} - fx) * fy + d.{value} * fx * fy) // {nw * nh} AS BIGINT) AS {value}
  FROM {name}_t t JOIN {source} a ON a.frame_id = t.frame_id AND a.x = x1 AND a.y = y1
  JOIN {source} b ON b.frame_id = t.frame_id AND b.x = least({w - 1}, x1 + 1) AND b.y = y1
  JOIN {source} c ON c.frame_id = t.frame_id AND c.x = x1 AND c.y = least({h - 1}, y1 + 1)
  JOIN {source} d ON d.frame_id = t.frame_id AND d.x = least({w - 1}, x1 + 1) AND d.y = least({h - 1}, y1 + 1))"""


@query("resize_bilinear", f"WITH {EV}, {resize_sql('ev', 'yy', W, H, 30, 20)} SELECT {big('frame_id x y yy')} FROM small")
def resize_bilinear(spark, sf):
    return T.resize(R.event_pixels(spark, sf), ["yy"], (W, H), (30, 20))


OIL = (4, 48, 1.5)  # brush, levels, sensitivity


def radius_cte(brush: int, levels: int, contrast: float) -> str:
    q = lambda c: f"{c} // {256 // levels} * {256 // levels}"
    own = f"br AS (SELECT frame_id, x, y, r, g, b, r * 299 + g * 587 + b * 114 AS bb, CAST({q('r')} * 65536 + {q('g')} * 256 + {q('b')} AS BIGINT) AS colour FROM rgb)"
    share = "least(1e0, CAST(ss - 2 * bb * s + n * bb * bb AS DOUBLE) / (CAST(n AS DOUBLE) * 65025e6))"
    return f"""{own}, {near_sql('br', 3, 'bb', 'nb', ', sum(bb * bb) AS ss, count(*) AS n')},
rad AS (SELECT a.frame_id, a.x, a.y, a.colour, CAST(greatest(2, least({brush}, floor({brush}e0 * (1e0 - least(0.8e0, {share} * {contrast}e0))))) AS BIGINT) AS radius FROM br a JOIN nb USING (frame_id, x, y))"""


def oil_pixels(px: DataFrame) -> DataFrame:
    px = T.brush_radius(with_rgb(px), OIL[0], OIL[2])
    levels = [P.quantise(F.col(c), OIL[1]) for c in "rgb"]
    return px.withColumn("colour", P.pack_argb(F.lit(0), *levels))


@query("oil_radius", f"WITH {PX}, {rgb_cte()}, {radius_cte(*OIL)} SELECT {big('frame_id x y radius colour')} FROM rad")
def oil_radius(spark, sf):
    return oil_pixels(R.event_pixels(spark, sf)).select("frame_id", "x", "y", "radius", "colour")


def oil_sql(brush: int, levels: int, contrast: float) -> str:
    span = f"range(-{brush}, {brush + 1})"
    return f"""WITH {PX}, {rgb_cte()}, {radius_cte(brush, levels, contrast)},
cnt AS (SELECT a.frame_id, a.x, a.y, s.colour AS c, count(*) AS n FROM rad a, {span} t1(dx), {span} t2(dy) JOIN rad s ON s.frame_id = a.frame_id AND s.x = a.x + dx AND s.y = a.y + dy WHERE dx * dx + dy * dy <= a.radius * a.radius GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY frame_id, x, y ORDER BY n DESC, c) AS k FROM cnt)
SELECT {big('frame_id x y')}, CAST(c AS BIGINT) AS colour FROM top WHERE k = 1"""


OIL_SQL = oil_sql(*OIL)


@query("oil_mode", OIL_SQL)
def oil_mode(spark, sf):
    return T.disc_mode(oil_pixels(R.event_pixels(spark, sf)), OIL[0], out="colour")


# Segments

SPACING = 8


def _jit(seg: str, k: int, most: int) -> str:
    return f"((({seg} * 8 + {k}) * 1103515245 + 12345) % 2147483648 // 65536 % {2 * most + 1} - {most})"


def glass_ctes(spacing: int, variation: int, thickness: int) -> tuple[str, str, str, str]:
    """seeds; the segment of each pixel, seg; their colours, cols; and edges."""
    across, down = (len(range(spacing // 2, n, spacing)) for n in (W, H))
    most, seg = spacing // 3, f"(cy * {across} + cx)"
    seeds = f"""seeds AS (SELECT {seg} AS seg, cx, cy, greatest(0, least({W - 1}, cx * {spacing} + {spacing // 2} + {_jit(seg, 0, most)})) AS sx,
  greatest(0, least({H - 1}, cy * {spacing} + {spacing // 2} + {_jit(seg, 1, most)})) AS sy FROM range({across}) a(cx), range({down}) b(cy))"""
    nearest = f"""map AS MATERIALIZED (SELECT x, y, min_by(seg, ((x - sx) * (x - sx) + (y - sy) * (y - sy)) * 100000 + seg) AS seg FROM range({W}) a(x), range({H}) b(y), seeds
  WHERE abs(x // {spacing} - cx) <= 1 AND abs(y // {spacing} - cy) <= 1 GROUP BY x, y)"""
    segs = f"WITH {PX}, {rgb_cte()}, {seeds}, {nearest}, seg AS (SELECT r.*, m.seg FROM rgb r JOIN map m USING (x, y))"
    moved = ", ".join(f"greatest(0, least(255, sum({c}) // count(*) + {_jit('seg', 2 + k, variation)})) AS {c}" for k, c in enumerate("rgb"))
    colours = f"cols AS (SELECT frame_id, seg, count(*) AS n, {moved} FROM seg GROUP BY frame_id, seg)"
    edges = f"""edges AS (SELECT DISTINCT a.frame_id, a.x + CASE WHEN k = 0 THEN t ELSE 0 END AS x, a.y + CASE WHEN k = 1 THEN t ELSE 0 END AS y FROM seg a, range(2) d(k), range({thickness}) e(t)
  JOIN seg b ON b.frame_id = a.frame_id AND b.x = a.x + 1 - k AND b.y = a.y + k WHERE a.x < {W - 1} AND a.y < {H - 1} AND b.seg <> a.seg)"""
    return seeds, segs, colours, edges


SEEDS, SEGS, COLOURS, EDGES = glass_ctes(SPACING, 12, 2)


@query("glass_seeds", f"WITH {SEEDS} SELECT {big('seg cx cy sx sy')} FROM seeds")
def glass_seeds(spark, sf):
    return S.seeds(spark, W, H, SPACING)


@query("glass_assign", f"{SEGS} SELECT {big('frame_id x y seg')} FROM seg")
def glass_assign(spark, sf):
    return S.assigned(R.event_pixels(spark, sf), W, H, SPACING).select("frame_id", "x", "y", "seg")


@query("glass_colours", f"{SEGS}, {COLOURS} SELECT {big('frame_id seg n r g b')} FROM cols")
def glass_colours(spark, sf):
    return S.segment_colours(S.assigned(R.event_pixels(spark, sf), W, H, SPACING))


@query("glass_edges", f"{SEGS}, {EDGES} SELECT {big('frame_id x y')} FROM edges WHERE x < {W} AND y < {H}")
def glass_edges(spark, sf):
    return S.segment_edges(S.assigned(R.event_pixels(spark, sf), W, H, SPACING), W, H, 2)


def glass_sql(spacing: int, thickness: int, edge, variation: int) -> str:
    _, segs, colours, edges = glass_ctes(spacing, variation, thickness)
    return f"""{segs}, {colours}, {edges} SELECT s.frame_id, s.x, s.y, {', '.join(f'CAST(CASE WHEN e.x IS NOT NULL THEN {k} ELSE c.{n} END AS BIGINT) AS {n}' for k, n in zip(edge, 'rgb'))}
FROM seg s JOIN cols c USING (frame_id, seg) LEFT JOIN edges e ON e.frame_id = s.frame_id AND e.x = s.x AND e.y = s.y"""


GLASS_SQL = glass_sql(SPACING, 2, (20, 30, 40), 12)


@query("stained_glass", GLASS_SQL)
def stained_glass(spark, sf):
    return S.stained_glass(R.event_pixels(spark, sf), W, H, SPACING, 2, (20, 30, 40))


# Seeds in rows of one to four, drawn anew for each frame

_uneven = f"""fm AS (SELECT DISTINCT frame_id FROM ev), rw AS (SELECT frame_id, c AS cy, 1 + (frame_id * 7 + c * 5) % 4 AS n FROM fm, range({-(-H // SPACING)}) t(c)),
sd0 AS (SELECT frame_id, cy, unnest(range(n)) AS k FROM rw), sd AS (SELECT frame_id, cy, row_number() OVER (PARTITION BY frame_id ORDER BY cy, k) - 1 AS seg, (frame_id * 31 + cy * 17 + k * (k + 3) * 11) % {W} AS sx,
  least({H - 1}, cy * {SPACING} + (frame_id * 13 + cy * 7 + k * 5) % {SPACING}) AS sy FROM sd0)"""
_uneven_seg = "seg AS (SELECT * FROM (SELECT rgb.*, sd.seg, row_number() OVER (PARTITION BY rgb.frame_id, x, y ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy), sd.seg) AS place FROM rgb JOIN sd USING (frame_id)) WHERE place = 1)"


def uneven_seeds(spark, sf) -> DataFrame:
    """(frame_id, row, k, sx, sy)."""
    f, row, k = F.col("frame_id"), F.col("row"), F.col("k")
    rows = R.event_pixels(spark, sf).select("frame_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(-(-H // SPACING) - 1))))
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), (f * 7 + row * 5) % 4)))
    return each.withColumns({"sx": (f * 31 + row * 17 + k * (k + 3) * 11) % W, "sy": F.least(F.lit(H - 1), row * SPACING + (f * 13 + row * 7 + k * 5) % SPACING)})


@query("uneven_seeds", f"WITH {EV}, {_uneven} SELECT {big('frame_id seg sx sy')}, CAST(cy AS BIGINT) AS row, CAST(count(*) OVER (PARTITION BY frame_id) AS BIGINT) AS total FROM sd")
def uneven_seeds_query(spark, sf):
    """The segments by number, and how many a frame has in all its rows."""
    own = S.numbered(uneven_seeds(spark, sf))
    return own.join(own.groupBy("frame_id").agg(F.count(F.lit(1)).alias("total")), "frame_id")


@query("uneven_assign", f"WITH {PX}, {rgb_cte()}, {_uneven}, {_uneven_seg} SELECT {big('frame_id x y seg')} FROM seg")
def uneven_assign(spark, sf):
    return S.assigned_by_rows(R.event_pixels(spark, sf), uneven_seeds(spark, sf), W, H, SPACING).select("frame_id", "x", "y", "seg")


@query("uneven_colours", f"WITH {PX}, {rgb_cte()}, {_uneven}, {_uneven_seg}, {COLOURS} SELECT {big('frame_id seg n r g b')} FROM cols")
def uneven_colours(spark, sf):
    return S.segment_colours(S.assigned_by_rows(R.event_pixels(spark, sf), uneven_seeds(spark, sf), W, H, SPACING))


# Backgrounds: two cells across, one down

CELLS = (((255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 0), (0, 255, 0, 255, 0, 0, 255, 255, 0, 0, 0, 255)),)
GRADIENT = G.GridGradient(CELLS, speed_x=250, speed_y=500, size_x=1.5, per_cell=20)
PHASE = "ph AS (SELECT DISTINCT frame_id, frame_id * 137 AS ts, CAST(floor(frame_id * 137 * 250 // 1000 % 2000 * 40 / 1000 + 0.5e0) AS BIGINT) % 40 AS dx, CAST(floor(frame_id * 137 * 500 // 1000 % 1000 * 20 / 1000 + 0.5e0) AS BIGINT) % 20 AS dy FROM ev)"


def _grad(k: int) -> str:
    corner = lambda j: f"CASE WHEN bx < 20 THEN {CELLS[0][0][j]} ELSE {CELLS[0][1][j]} END"
    top, low = (f"(({corner(k + j)}) * (19 - bx % 20) + ({corner(k + 3 + j)}) * (bx % 20))" for j in (0, 6))
    return f"({top} * (19 - by_ % 20) + {low} * (by_ % 20)) * 2 + 361"


GRAD = f"{PHASE}, bp AS (SELECT e.*, (dx + x * 30 // {W}) % 40 AS bx, (dy + y * 20 // {H}) % 20 AS by_ FROM {{0}} e JOIN ph USING (frame_id)), bg AS (SELECT *, {', '.join(f'({_grad(k)}) // 722 AS {n}' for k, n in enumerate(('br', 'bgr', 'bb')))} FROM bp)"


def background(px: DataFrame) -> tuple:
    return G.grid_background(GRADIENT, F.col("x"), F.col("y"), F.col("frame_id") * R.FRAME_MS, W, H)


@query("gradient_phase", f"WITH {EV}, {PHASE} SELECT {big('frame_id ts dx dy')} FROM ph")
def gradient_phase(spark, sf):
    frames = table(spark, sf, "events").select(F.floor(F.col("event_id") / 1000).alias("frame_id")).distinct().withColumn("ts", F.col("frame_id") * R.FRAME_MS)
    dx, dy = G.gradient_phase(GRADIENT, F.col("ts"))
    return frames.select("frame_id", "ts", dx.alias("dx"), dy.alias("dy"))


@query("gradient_grid", f"WITH {EV}, {GRAD.format('ev')} SELECT {big('frame_id x y')}, CAST(br AS BIGINT) AS r, CAST(bgr AS BIGINT) AS g, CAST(bb AS BIGINT) AS b FROM bg")
def gradient_grid(spark, sf):
    px = R.event_pixels(spark, sf)
    return at(px, **rgb(background(px)))


@query("edge_grid_gradient", f"WITH {EV}, {edge_cte('ev', W, H, 2)}, {GRAD.format('edge')} SELECT {big('frame_id x y')}, " + ", ".join(f"CAST((0 * (255 - e) + {c} * e + 127) // 255 AS BIGINT) AS {n}" for c, n in (("br", "r"), ("bgr", "g"), ("bb", "b"))) + " FROM bg")
def edge_grid_gradient(spark, sf):
    px = T.edges(R.event_pixels(spark, sf), W, H)
    return at(px, **rgb(P.source_over((F.lit(0), F.lit(0), F.lit(0)), 255 - F.col("edge"), background(px))))


def _blend(share: str, a, b) -> str:
    return ", ".join(f"CAST(floor(({share}) * {y - x}e0 + {x}e0 + 0.5e0) AS BIGINT) AS {n}" for x, y, n in zip(a, b, "rgb"))


@query("gradient_linear", f"WITH {EV} SELECT {big('frame_id x y')}, {_blend(f'CAST(x * {W} + y * {H} AS DOUBLE) / {float(W * W + H * H)}e0', (0, 255, 0), (0, 0, 255))} FROM ev")
def gradient_linear(spark, sf):
    return at(R.event_pixels(spark, sf), **rgb(G.linear_background(F.col("x"), F.col("y"), W, H, (0, 255, 0), (0, 0, 255))))


_rad = f"sqrt(CAST((2 * x - {W}) * (2 * x - {W}) + (2 * y - {H}) * (2 * y - {H}) AS DOUBLE)) / {float(W)}e0"


@query("gradient_radial", f"WITH {EV}, sh AS (SELECT *, {_rad} AS s0 FROM ev), mi AS (SELECT *, CASE WHEN s0 > 1 THEN 2e0 - s0 ELSE s0 END AS s FROM sh) SELECT {big('frame_id x y')}, {_blend('s', (255, 255, 0), (255, 70, 0))} FROM mi")
def gradient_radial(spark, sf):
    return at(R.event_pixels(spark, sf), **rgb(G.radial_background(F.col("x"), F.col("y"), W, H, (255, 255, 0), (255, 70, 0))))


# Geometry

_turn = f"t AS (SELECT frame_id, x, y, yy, frame_id % 2 = 1 AS xf, frame_id % 3 = 1 AS yf, frame_id % 2 = 0 AS po FROM ev), p AS (SELECT *, CASE WHEN po THEN {H - 1} - y ELSE x END AS px, CASE WHEN po THEN x ELSE y END AS py, CASE WHEN po THEN {H} ELSE {W} END AS w, CASE WHEN po THEN {W} ELSE {H} END AS h, CASE WHEN po THEN yf ELSE xf END AS fh, CASE WHEN po THEN xf ELSE yf END AS fv FROM t)"


@query("orient_remap", f"WITH {EV}, {_turn} SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST(CASE WHEN fh THEN w - 1 - px ELSE px END AS BIGINT) AS x, CAST(CASE WHEN fv THEN h - 1 - py ELSE py END AS BIGINT) AS y, CAST(yy AS BIGINT) AS yy FROM p")
def orient_remap(spark, sf):
    px = R.event_pixels(spark, sf)
    f = F.col("frame_id")
    x, y = G.oriented(F.col("x"), F.col("y"), W, H, f % 2 == 1, f % 3 == 1, f % 2 == 0)
    return px.select("frame_id", x.alias("x"), y.alias("y"), "yy")


@query("tile_grid", f"WITH {EV}, {resize_sql('ev', 'yy', W, H, 10, 6)}, tl AS (SELECT frame_id, i, x, y, CASE i WHEN 0 THEN yy WHEN 1 THEN 255 - yy WHEN 2 THEN yy // 85 * 85 ELSE (yy + 128) % 256 END AS v FROM small, range(4) t(i)) SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST((1 - i % 2) * 10 + x AS BIGINT) AS x, CAST(i // 2 * 6 + y AS BIGINT) AS y, CAST(v AS BIGINT) AS v FROM tl")
def tile_grid(spark, sf):
    small = T.resize(R.event_pixels(spark, sf), ["yy"], (W, H), (10, 6))
    yy = F.col("yy")
    values = F.array(yy, 255 - yy, (F.floor(yy / 85) * 85).cast("int"), (yy + 128) % 256)
    return G.tiled(small.select("frame_id", "x", "y", F.posexplode(values).alias("tile", "v")), (10, 6), 2, x_flipped=True)


@query("tile_touch", f"WITH {EV} SELECT {big('frame_id x y')}, CAST(greatest(0, least(35, y * 7 // 29 * 6 + x * 9 // 60)) AS BIGINT) AS tile FROM ev")
def tile_touch(spark, sf):
    return at(R.event_pixels(spark, sf), tile=N.tile_index(F.col("x") * 9, F.col("y") * 7, 360, 175, 36))


QUERIES["tile_touch_all"], ORACLES["tile_touch_all"] = QUERIES["tile_touch"], ORACLES["tile_touch"]  # an older name


_sizes = "sz AS (SELECT p_partkey AS k, 100 + p_size * 37 AS w, 100 + p_partkey % 91 * 13 AS h FROM part)"


def sizes(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 37 + 100).alias("w"), (F.col("p_partkey") % 91 * 13 + 100).alias("h"))


@query("fit_size", f"WITH {_sizes} SELECT CAST(k AS BIGINT) AS k, CAST(floor(w * least(CAST(480 AS DOUBLE) / w, CAST(360 AS DOUBLE) / h) + 0.5e0) AS BIGINT) AS fw, CAST(floor(h * least(CAST(480 AS DOUBLE) / w, CAST(360 AS DOUBLE) / h) + 0.5e0) AS BIGINT) AS fh FROM sz")
def fit_size(spark, sf):
    w, h = N.fit_size("w", "h", 480, 360)
    return sizes(spark, sf).select("k", w.alias("fw"), h.alias("fh"))


@query("zoom_crop", f"WITH {_sizes}, z AS (SELECT k, w, h, CAST(floor(floor(w / sqrt(4e0)) / 2) AS BIGINT) AS a, CAST(floor(floor(h / sqrt(4e0)) / 2) AS BIGINT) AS b FROM sz) SELECT CAST(k AS BIGINT) AS k, CAST(w // 2 - a AS BIGINT) AS x0, CAST(h // 2 - b AS BIGINT) AS y0, CAST(w // 2 + a AS BIGINT) AS x1, CAST(h // 2 + b AS BIGINT) AS y1 FROM z")
def zoom_crop(spark, sf):
    return sizes(spark, sf).select("k", *[c.alias(n) for n, c in N.zoom_crop("w", "h", 4.0, F.lit(0.5)).items()])


@query("downsample_factor", f"WITH {_sizes} SELECT CAST(k AS BIGINT) AS k, CAST(CASE WHEN m <= 1 THEN 1 WHEN m <= 2 THEN 2 WHEN m <= 4 THEN 4 WHEN m <= 8 THEN 8 WHEN m <= 16 THEN 16 ELSE 32 END AS BIGINT) AS factor FROM (SELECT k, greatest(w / 300, h / 200) AS m FROM sz)")
def downsample_factor(spark, sf):
    return sizes(spark, sf).select("k", N.downsample_factor("w", "h", 300, 200).alias("factor"))


@query("char_grid_metrics", f"""WITH {_sizes}, a AS (SELECT *, k % 2 = 1 AS po, CASE WHEN k % 2 = 1 THEN h ELSE w END AS across, CASE WHEN k % 2 = 1 THEN w ELSE h END AS down FROM sz),
b AS (SELECT *, least(120, across // 10) AS n_columns FROM a), c AS (SELECT *, across // n_columns AS cell_w, (across // n_columns * 18 + 5) // 10 AS cell_h FROM b), d AS (SELECT *, down // cell_h AS n_rows FROM c),
e AS (SELECT *, CASE WHEN po THEN n_rows * cell_h ELSE n_columns * cell_w END AS out_w, CASE WHEN po THEN n_columns * cell_w ELSE n_rows * cell_h END AS out_h FROM d)
SELECT {big('k n_columns n_rows cell_w cell_h out_w out_h')} FROM e""")
def char_grid_metrics(spark, sf):
    return sizes(spark, sf).select("k", *[c.alias(n) for n, c in N.char_grid("w", "h", F.col("k") % 2 == 1, 120, 10).items()])
