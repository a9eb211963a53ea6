"""Queries that carry state along each video, over tables and over streams, with their DuckDB forms (recursive where state needs it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline as T
from ..streaming import replay as S
from ..streaming import rules as U
from ..streaming.ending import over_ending_stream
from .common import big, whole
from .media import ORACLES as MEDIA
from .media import TL, arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROOM, SERVICE_MS, STEP_MS = 3, 20 * 3_600_000, 137
TTL_MS, MOST_DROPS, ONE_IN = 5000, 3, 20


def both(name: str, sql: str):
    """Registers a rule's query over the table and, with stream_ before the name, over a stream."""

    def add(f):
        def table_form(spark, sf):
            rows, _, rule = f(spark, sf)
            return whole(U.over_table(rows, rule))

        def stream_form(spark, sf):
            rows, by, rule = f(spark, sf)
            return whole(S.run(rows, by, lambda stream: U.over_stream(stream, rule)))

        QUERIES[name], QUERIES[f"stream_{name}"] = table_form, stream_form
        ORACLES[name] = ORACLES[f"stream_{name}"] = sql
        return f

    return add


@both("not_late", MEDIA["late_drop"])
def not_late(spark, sf):
    return arrivals(spark, sf), "event_id", U.NOT_LATE


QUERIES["not_late"] = lambda spark, sf: whole(T.not_late(arrivals(spark, sf)))  # over a table a running maximum says the same, in slices of time


@both("bounded_queue", f"""WITH RECURSIVE {TL}, q AS (
  SELECT video, frame, ms + {SERVICE_MS} AS free, []::BIGINT[] AS waiting, false AS lost FROM tl WHERE frame = 0
  UNION ALL SELECT video, frame, CASE WHEN lost THEN free ELSE begins + {SERVICE_MS} END, CASE WHEN NOT lost AND begins > ms THEN list_append(still, begins) ELSE still END, lost
  FROM (SELECT *, len(still) >= {ROOM} AS lost, greatest(ms, free) AS begins FROM (SELECT t.video, t.frame, t.ms, q.free, list_filter(q.waiting, lambda b: b > t.ms) AS still FROM q JOIN tl t ON t.video = q.video AND t.frame = q.frame + 1)))
SELECT {big('video frame')}, lost FROM q""")
def bounded_queue(spark, sf):
    rows = T.event_timeline(spark, sf).select("video", "frame", "ms", "event_id")
    return rows, "frame", U.bounded_queue(ROOM, SERVICE_MS)


def _n(key: str, k: int) -> str:
    return f"((({key}) * 8 + {k}) * 1103515245 + 12345) % 2147483648 // 65536"


_ERA = "fr AS (SELECT video, frame, CASE WHEN frame < 40 THEN 600 ELSE 300 END AS n FROM tl)"
_SEED = "video * 1000003 + frame * 16 + j"


@both("persistent_grid", f"""WITH {TL}, {_ERA}, ch AS (SELECT video, frame, n, j, {_n(_SEED, 1)} % n AS cell, {_n(_SEED, 2)} % 64 AS value FROM fr, range(2) t(j) WHERE j < n // 300),
la AS (SELECT video, frame, cell, arg_max(value, j) AS value FROM ch GROUP BY ALL), st AS (SELECT * FROM fr WHERE frame IN (0, 40)),
whole_ AS (SELECT video, frame, cell, {_n('video * 1009 + cell', 0)} % 64 AS value FROM (SELECT video, frame, unnest(range(n)) AS cell FROM st))
SELECT {big('video frame cell value')} FROM (SELECT w.video, w.frame, w.cell, coalesce(la.value, w.value) AS value FROM whole_ w LEFT JOIN la USING (video, frame, cell) UNION ALL SELECT * FROM la WHERE frame NOT IN (0, 40))""")
def persistent_grid(spark, sf):
    frames = T.event_timeline(spark, sf)
    return frames.select("video", "frame", F.when(F.col("frame") < 40, 600).otherwise(300).alias("n_cells")), "frame", U.persistent_grid()


_LIVE = f"list_filter(starts, lambda s: f.ms - s BETWEEN 0 AND {TTL_MS})"


@both("falling_drops", f"""WITH RECURSIVE {TL}, fr AS (SELECT video, frame, frame * {STEP_MS} AS ms, {_n('video * 7919 + frame', 3)} % {ONE_IN} = 0 AS luck FROM tl), q AS (
  SELECT video, frame, CASE WHEN luck THEN [ms] ELSE []::BIGINT[] END AS starts, luck AS begun FROM fr WHERE frame = 0
  UNION ALL SELECT video, frame, CASE WHEN luck AND len(alive) < {MOST_DROPS} THEN list_append(alive, ms) ELSE alive END, luck AND len(alive) < {MOST_DROPS}
  FROM (SELECT f.video, f.frame, f.ms, f.luck, {_LIVE} AS alive FROM q JOIN fr f ON f.video = q.video AND f.frame = q.frame + 1))
SELECT {big('video frame')}, CAST(len(starts) AS BIGINT) AS alive, begun FROM q""")
def falling_drops(spark, sf):
    frames = T.event_timeline(spark, sf)
    return frames.select("video", "frame", (F.col("frame") * STEP_MS).alias("ms")), "frame", U.falling_drops(TTL_MS, MOST_DROPS, ONE_IN)


N_TILES, BUDGET_MS = 36, 50
_COST = "1 + (event_id * 31 + i * 17 + video) % 23"
_SPENT = f"list_transform(range(1, {N_TILES} + 1), lambda k: list_sum(turned[1:k]))"


@both("tile_refresh", f"""WITH RECURSIVE {TL}, fr AS (SELECT video, frame, [{_COST} FOR i IN range({N_TILES})] AS costs FROM tl), q AS (
  SELECT video, -1::BIGINT AS frame, 0::BIGINT AS cursor, 0::BIGINT AS first, []::BIGINT[] AS spent FROM fr WHERE frame = 0
  UNION ALL SELECT video, frame, (cursor + drawn) % {N_TILES}, cursor, CAST(spent[1:drawn] AS BIGINT[])
  FROM (SELECT *, least({N_TILES}, len(list_filter(spent, lambda x: x <= {BUDGET_MS})) + 1) AS drawn
    FROM (SELECT video, frame, cursor, {_SPENT} AS spent FROM (SELECT f.video, f.frame, q.cursor, f.costs[q.cursor + 1:] || f.costs[:q.cursor] AS turned FROM q JOIN fr f ON f.video = q.video AND f.frame = q.frame + 1))))
SELECT {big('video frame place')}, CAST((first + place) % {N_TILES} AS BIGINT) AS tile, CAST(spent_ms AS BIGINT) AS spent_ms
FROM (SELECT video, frame, first, unnest(range(len(spent))) AS place, unnest(spent) AS spent_ms FROM q WHERE frame >= 0)""")
def tile_refresh(spark, sf):
    """The 36 effects of a grid, redrawn within 50 ms a frame; what an effect costs is a number of the frame and the effect."""
    own = T.event_timeline(spark, sf)
    costs = F.transform(F.sequence(F.lit(0), F.lit(N_TILES - 1)), lambda i: 1 + (F.col("event_id") * 31 + i * 17 + F.col("video")) % 23)
    return own.select("video", "frame", costs.alias("costs")), "frame", U.tile_refresh(N_TILES, BUDGET_MS)


def ending_drops(spark, sf):
    """Falling drops as a stream whose idle videos are forgotten: what goes is the state of videos that have no more frames."""
    frames = T.event_timeline(spark, sf)
    at = F.timestamp_millis(F.col("frame") * STEP_MS + 86_400_000)  # the watermark begins at 1970, and what isn't later is late
    rows = frames.select("video", "frame", (F.col("frame") * STEP_MS).alias("ms"), at.alias("at"))
    rule = U.falling_drops(TTL_MS, MOST_DROPS, ONE_IN)
    return whole(S.run(rows, "frame", lambda stream: over_ending_stream(stream, rule, "at", "0 seconds", 4 * TTL_MS)))


QUERIES["stream_ending_drops"], ORACLES["stream_ending_drops"] = ending_drops, ORACLES["falling_drops"]


SLICES = 3


def _latest(spark, sf):
    return whole(S.run_latest(T.event_timeline(spark, sf).select("video", "event_id", "ms"), "event_id", ["video"], SLICES))


QUERIES["stream_latest"] = _latest
ORACLES["stream_latest"] = f"""WITH {TL}, e AS (SELECT max(event_id) + 1 AS n FROM tl), s AS (SELECT video, event_id, ms, CASE WHEN event_id < n // 3 THEN 0 WHEN event_id < n * 2 // 3 THEN 1 ELSE 2 END AS batch FROM tl, e)
SELECT {big('batch video event_id ms')} FROM (SELECT *, row_number() OVER (PARTITION BY batch, video ORDER BY event_id DESC) AS r FROM s) WHERE r = 1"""
