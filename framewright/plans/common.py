"""What the queries share: output types, and the DuckDB forms of the synthetic inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def whole(df: DataFrame) -> DataFrame:
    """df with integers of any width as long."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in INTEGERS else F.col(c) for c, t in df.dtypes])


def big(columns: str) -> str:
    """SQL: the columns as BIGINT."""
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns.split())


EV = """ev AS (SELECT event_id // 1000 AS frame_id, event_id % 1000 % 40 AS x, event_id % 1000 // 40 AS y,
  (CAST(floor(value * 100) AS BIGINT) + user_id * 7) % 256 AS yy,
  (event_id * 37 + user_id) % 256 AS pu, (event_id * 91 + user_id * 5) % 256 AS pv FROM events)"""
PX = EV + """,
px AS (SELECT a.frame_id, a.x, a.y, a.yy, c.pu AS uu, c.pv AS vv FROM ev a
  JOIN ev c ON c.frame_id = a.frame_id AND c.x = a.x // 2 * 2 AND c.y = a.y // 2 * 2)"""
VEC = """vec AS MATERIALIZED (SELECT vec_id // 50 AS frame_id, x, vec_id % 50 AS y, CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS yy
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS x FROM embeddings))"""


def rgb_sql(y: str = "yy", u: str = "uu", v: str = "vv", k: tuple[int, int, int, int] = (351, 179, 86, 443)) -> tuple[str, str, str]:
    u, v = f"({u} - 128)", f"({v} - 128)"
    shift = lambda e: f"CAST(floor(({e}) / 256) AS BIGINT)"
    out = f"{y} + {shift(f'{k[0]} * {v}')}", f"{y} - {shift(f'{k[1]} * {v} + {k[2]} * {u}')}", f"{y} + {shift(f'{k[3]} * {u}')}"
    return tuple(f"greatest(0, least(255, {e}))" for e in out)


def rgb_cte(source: str = "px", name: str = "rgb", **how) -> str:
    r, g, b = rgb_sql(**how)
    return f"{name} AS (SELECT frame_id, x, y, yy, uu, vv, {r} AS r, {g} AS g, {b} AS b FROM {source})"


def near_sql(source: str, radius: int, value: str, name: str, also: str = "") -> str:
    """Sums over the squares around places, by sending every value to its neighbours."""
    span = f"range(-{radius}, {radius + 1})"
    return f"{name} AS (SELECT frame_id, x + dx AS x, y + dy AS y, sum({value}) AS s{also} FROM {source}, {span} t1(dx), {span} t2(dy) GROUP BY ALL)"


def edge_cte(source: str, w: int, h: int, m: int, name: str = "edge", value: str = "yy") -> str:
    """Edge strengths from sums over rows and then columns of three."""
    near = lambda by, at: f"OVER (PARTITION BY frame_id, {by} ORDER BY {at} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return f"""{name}_row AS (SELECT *, sum({value}) {near('y', 'x')} AS s1 FROM {source}),
{name}_sum AS (SELECT *, sum(s1) {near('x', 'y')} AS s9 FROM {name}_row),
{name} AS (SELECT *, CASE WHEN x BETWEEN 1 AND {w - 2} AND y BETWEEN 1 AND {h - 2} THEN greatest(0, least(255, {m} * (9 * {value} - s9))) ELSE 0 END AS e FROM {name}_sum)"""


def conv_cte(source: str, kernel, name: str = "conv") -> str:
    """A 3 x 3 convolution: each value of a row with its neighbours, a border's own where there is none, and then those of the rows around."""
    side = lambda step, v, by, at: f"coalesce({step}({v}) OVER (PARTITION BY frame_id, {by} ORDER BY {at}), {v})"
    row = f"{name}_row AS (SELECT *, {side('lag', 'yy', 'y', 'x')} AS c0, yy AS c1, {side('lead', 'yy', 'y', 'x')} AS c2 FROM {source})"
    taps = [t for step in ("lag", "", "lead") for t in (side(step, c, "x", "y") if step else c for c in ("c0", "c1", "c2"))]
    number = lambda c: repr(float(c)) if "e" in repr(float(c)) else f"{float(c)!r}e0"
    total = " + ".join(f"{t} * {number(c)}" for t, c in zip(taps, kernel) if c)
    return f"{row}, {name} AS (SELECT frame_id, x, y, CAST(greatest(0, least(255, floor(0e0 + {total} + 0.5e0))) AS BIGINT) AS conv FROM {name}_row)"


def map_sql(i: str, low: tuple[int, int, int], high: tuple[int, int, int]) -> str:
    """r, g, b of a colour map, rounded halves up (there are none)."""
    return ", ".join(f"CAST(floor({a} + {i} * ({b - a}) / 255e0 + 0.5e0) AS BIGINT) AS {n}" for a, b, n in zip(low, high, "rgb"))
