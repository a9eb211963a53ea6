"""Queries of timelines, the catalog, audio and raw bytes, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import audio as A
from ..operators import catalog as C
from ..operators import timeline as T
from ..session import table
from ..sources import frames as R
from .common import big, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: whole(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


TL = """tl AS (SELECT user_id AS video, epoch_us(ts) // 1000 AS ms, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS frame FROM events)"""
SUM = "sm AS (SELECT video, count(*) AS n_frames, min(ms) AS first_ms, max(ms) AS last_ms, coalesce((max(ms) - min(ms)) // nullif(count(*) - 1, 0), 0) AS average_ms FROM tl GROUP BY video)"
DUR = "du AS (SELECT tl.*, coalesce(lead(ms) OVER (PARTITION BY video ORDER BY frame) - ms, average_ms) AS duration_ms FROM tl JOIN sm USING (video))"


@query("video_summary", f"WITH {TL}, {SUM} SELECT {big('video n_frames first_ms last_ms average_ms')}, CAST(last_ms - first_ms + average_ms AS BIGINT) AS total_ms FROM sm")
def video_summary(spark, sf):
    return T.video_summary(T.event_timeline(spark, sf))


@query("frame_durations", f"WITH {TL}, {SUM}, {DUR} SELECT {big('video frame ms duration_ms')} FROM du")
def frame_durations(spark, sf):
    return T.frame_durations(T.sliced_timeline(spark, sf)).select("video", "frame", "ms", "duration_ms")


@query("frame_pts", f"WITH {TL}, {SUM}, {DUR} SELECT {big('video frame')}, CAST(1000 * (sum(duration_ms) OVER (PARTITION BY video ORDER BY frame) - duration_ms) AS BIGINT) AS pts_us FROM du")
def frame_pts(spark, sf):
    return T.frame_times(T.sliced_timeline(spark, sf)).select("video", "frame", "pts_us")


def elapsed(frames: DataFrame) -> DataFrame:
    return frames.select("video", F.col("frame").alias("base"), (F.col("event_id") * 7919 % 900_000).alias("delta_ms"))


@query("next_frame_asof", f"""WITH {TL}, a AS (SELECT video, frame AS base, ms AS base_ms, event_id * 7919 % 900000 AS delta_ms FROM tl)
SELECT {big('video base delta_ms')}, CAST(coalesce((SELECT min(frame) FROM tl t WHERE t.video = a.video AND t.ms > a.base_ms + a.delta_ms), (SELECT max(frame) FROM tl t WHERE t.video = a.video)) AS BIGINT) AS next FROM a""")
def next_frame_asof(spark, sf):
    frames = T.sliced_timeline(spark, sf)
    return T.next_frame(frames, elapsed(frames))


QUERIES["next_frame_asof_all"], ORACLES["next_frame_asof_all"] = QUERIES["next_frame_asof"], ORACLES["next_frame_asof"]  # an older name


STEP = 3_600_000


@query("nearest_frame", f"""WITH {TL}, {SUM}, s AS (SELECT video, unnest(range(0, (last_ms - first_ms) // {STEP} + 1)) AS k, first_ms FROM sm), a AS (SELECT video, k, first_ms + k * {STEP} AS at_ms FROM s),
o AS (SELECT a.*, frame, row_number() OVER (PARTITION BY video, k ORDER BY abs(ms - at_ms), ms, frame) AS r FROM a JOIN tl USING (video)) SELECT {big('video k at_ms frame')} FROM o WHERE r = 1""")
def nearest_frame(spark, sf):
    return T.nearest_at_steps(T.sliced_timeline(spark, sf), STEP)


_fps = "fp AS (SELECT video, CASE WHEN count(*) > 1 AND max(ms) > min(ms) THEN (count(*) - 1) * 1000e0 / (max(ms) - min(ms)) ELSE 30e0 END AS fps FROM tl WHERE frame < 180 GROUP BY video)"


@query("fps_estimate", f"WITH {TL}, {_fps} SELECT CAST(video AS BIGINT) AS video, fps FROM fp")
def fps_estimate(spark, sf):
    return T.rate_estimate(T.event_timeline(spark, sf))


@query("import_preflight", f"""WITH {TL}, {SUM}, {_fps}, a AS (SELECT video, 100 + video % 50 * 40 AS w, 100 + video % 31 * 50 AS h, last_ms - first_ms AS ms, least(30e0, greatest(1e0, fps)) AS target_fps FROM sm JOIN fp USING (video)),
b AS (SELECT *, CAST(floor(w * (640e0 / greatest(w, h)) + 0.5e0) AS BIGINT) AS dw, CAST(floor(h * (640e0 / greatest(w, h)) + 0.5e0) AS BIGINT) AS dh, CAST(ceil(ms / 1000e0 * target_fps) AS BIGINT) AS n_frames FROM a),
c AS (SELECT *, dw + dw % 2 AS dst_w, dh + dh % 2 AS dst_h FROM b)
SELECT {big('video dst_w dst_h n_frames')}, target_fps, CAST(n_frames * (dst_w * dst_h * 3 // 2) + floor(88200e0 * (ms / 1000e0)) AS BIGINT) AS n_bytes FROM c""")
def import_preflight(spark, sf):
    frames = T.event_timeline(spark, sf)
    own = T.video_summary(frames).join(T.rate_estimate(frames), "video")
    own = own.withColumns({"w": F.col("video") % 50 * 40 + 100, "h": F.col("video") % 31 * 50 + 100, "ms": F.col("last_ms") - F.col("first_ms")})
    return own.select("video", *[c.alias(n) for n, c in N.import_plan("w", "h", "ms", "fps").items()])


@query("av_interleave", f"""WITH {TL}, v AS (SELECT video, 'v' AS kind, frame AS number, ms AS "at", ms AS t FROM tl WHERE frame % 2 = 0), a0 AS (SELECT video, frame AS number, ms AS "at", lead(ms) OVER (PARTITION BY video ORDER BY frame) AS nx FROM tl WHERE frame % 2 = 1),
a AS (SELECT video, 'a' AS kind, number, "at", coalesce(nx, "at" + 1000) AS t FROM a0)
SELECT CAST(video AS BIGINT) AS video, kind, CAST(number AS BIGINT) AS number, CAST("at" AS BIGINT) AS "at", CAST(row_number() OVER (PARTITION BY video ORDER BY t, kind, number) - 1 AS BIGINT) AS place FROM (SELECT * FROM v UNION ALL SELECT * FROM a)""")
def av_interleave(spark, sf):
    frames = T.sliced_timeline(spark, sf).select("video", F.col("frame").alias("number"), F.col("ms").alias("at"))
    return T.interleaved(frames.filter(F.col("number") % 2 == 0), T.followed(frames.filter(F.col("number") % 2 == 1), 1000))


@query("latest_per_stream", f"WITH {TL} SELECT CAST(video AS BIGINT) AS video, event_type, {big('ms event_id')} FROM (SELECT *, row_number() OVER (PARTITION BY video, event_type ORDER BY ms DESC, event_id DESC) AS r FROM tl) WHERE r = 1")
def latest_per_stream(spark, sf):
    return T.latest(T.event_timeline(spark, sf).select("video", "event_type", "ms", "event_id"), ["video", "event_type"])


_arr = "ar AS (SELECT video, event_id, ms - CASE WHEN event_id % 11 = 0 THEN 7200000 ELSE 0 END AS ms FROM tl)"


def arrivals(spark, sf) -> DataFrame:
    late = F.when(F.col("event_id") % 11 == 0, 7_200_000).otherwise(0)
    events = table(spark, sf, "events").select(F.col("user_id").alias("video"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return events.select("video", "event_id", (F.col("ms") - late).alias("ms"))


@query("late_drop", f"WITH {TL}, {_arr} SELECT {big('video event_id ms')} FROM ar a WHERE NOT EXISTS (SELECT 1 FROM ar b WHERE b.video = a.video AND b.event_id < a.event_id AND b.ms > a.ms)")
def late_drop(spark, sf):
    return T.not_late(arrivals(spark, sf))


@query("running_stats", f"WITH {TL} SELECT {big('video frame')}, CAST(floor(1000 * avg(ms) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 0.5e0) AS BIGINT) AS mean FROM (SELECT video, frame, event_id % 977 AS ms FROM tl)")
def running_stats(spark, sf):
    own = T.sliced_timeline(spark, sf).withColumn("took", F.col("event_id") % 977)
    return T.running_mean(own, "took").select("video", "frame", F.floor(F.col("mean") * 1000 + 0.5).alias("mean"))


# Catalog

ITEMS = TL + """, it AS (SELECT video, min(ms) AS timestamp, list(ms ORDER BY frame) AS ft, count(*) AS n, strftime(make_timestamp(min(ms) * 1000), '%Y-%m-%d-%H-%M-%S-%g') AS item_id,
  list_extract(['edge', 'edge_luminance', 'solid_color', 'convolve3x3', 'permute_color', 'cartoon', 'ascii', 'matrix', 'oil_painting', 'stained_glass'], CAST(video % 10 AS INTEGER) + 1) AS effect, '{"n":' || (video % 7) || '}' AS params FROM tl GROUP BY video)"""
FILES = """fi AS (SELECT item_id, video, list_extract(['photo_raw', 'video_raw', 'audio_raw', 'thumbnail', 'rendered', 'exported'], CAST(k AS INTEGER) + 1) AS kind, CAST(n * (k + 1) * 1500 + video AS BIGINT) AS length FROM it, range(6) t(k) WHERE (video + k) % 3 <> 0)"""


@query("media_ids", f"WITH {ITEMS} SELECT item_id, {big('video timestamp')}, CASE WHEN n > 1 THEN 'VIDEO' ELSE 'IMAGE' END AS type, effect, params FROM it")
def media_ids(spark, sf):
    return C.media_items(spark, sf).drop("frame_timestamps")


@query("media_files", f"WITH {ITEMS}, {FILES} SELECT item_id, CAST(video AS BIGINT) AS video, kind, length FROM fi")
def media_files(spark, sf):
    return C.media_files(C.media_items(spark, sf))


@query("media_sizes", f"""WITH {ITEMS}, {FILES}, s AS (SELECT item_id, video, count(*) AS n_files, sum(length) AS length FROM fi GROUP BY ALL)
SELECT item_id, CAST(video AS BIGINT) AS video, CAST(n_files AS BIGINT) AS n_files, CAST(length AS BIGINT) AS length, CASE WHEN length >= 10000000 THEN (length // 1000000)::VARCHAR ELSE (length // 1000000) || '.' || (length // 100000 % 10) END AS shown FROM s""")
def media_sizes(spark, sf):
    items = C.media_items(spark, sf)
    return C.item_sizes(items, C.media_files(items)).withColumn("shown", N.megabytes("length"))


@query("media_listing", f"WITH {ITEMS} SELECT CAST(row_number() OVER (ORDER BY item_id DESC, video) - 1 AS BIGINT) AS place, item_id, CAST(video AS BIGINT) AS video, CASE WHEN n > 1 THEN 'VIDEO' ELSE 'IMAGE' END AS type, CAST(n AS BIGINT) AS frames FROM it")
def media_listing(spark, sf):
    return C.listing(C.media_items(spark, sf))


@query("media_json", f"WITH {ITEMS} SELECT item_id, CAST(video AS BIGINT) AS video, effect, params, CAST(n AS BIGINT) AS frames, CAST(ft[1] AS BIGINT) AS first_ms, false AS portrait, 0::BIGINT AS audio_start, 2::BIGINT AS exports, 'solid_color' AS replaced FROM it")
def media_json(spark, sf):
    docs = C.read_metadata(C.metadata_json(C.media_items(spark, sf)))
    effect = lambda name: F.struct(F.lit(name).alias("name"), F.lit("{}").alias("params"))
    docs = C.with_export(C.with_export(C.with_export(docs, F.lit("webm"), effect("edge")), F.lit("zip"), effect("ascii")), F.lit("webm"), effect("solid_color"))
    meta = F.col("meta")
    return docs.select("item_id", "video", meta["effect"]["name"].alias("effect"), meta["effect"]["params"].alias("params"), F.size(meta["frameTimestamps"]).alias("frames"), F.get(meta["frameTimestamps"], F.lit(0)).alias("first_ms"),
                       meta["portrait"].alias("portrait"), meta["audioStartTimestamp"].alias("audio_start"), F.size(meta["exportedEffects"]).alias("exports"), F.element_at(meta["exportedEffects"], F.lit("webm"))["name"].alias("replaced"))


@query("export_cache", f"""WITH {ITEMS}, {FILES}, ex AS (SELECT item_id, video, CASE WHEN video % 2 = 0 THEN 'rendered' ELSE 'exported' END AS kind, video % 4 <> 3 AS same FROM it)
SELECT ex.item_id, CAST(ex.video AS BIGINT) AS video, ex.kind, same AND fi.length IS NOT NULL AS valid FROM ex LEFT JOIN fi ON fi.item_id = ex.item_id AND fi.video = ex.video AND fi.kind = ex.kind""")
def export_cache(spark, sf):
    items = C.media_items(spark, sf)
    v = F.col("video")
    # the same number written otherwise is the same; every fourth export has other parameters
    params = F.concat(F.lit('{"n":'), F.when(v % 4 == 3, v % 7 + 1).otherwise(v % 7).cast("string"), F.lit(".0}"))
    exports = items.select("item_id", "video", F.when(v % 2 == 0, "rendered").otherwise("exported").alias("kind"), F.col("effect").alias("name"), params.alias("params"))
    return C.valid_exports(items, C.media_files(items), exports)


@query("delete_items", f"WITH {ITEMS}, {FILES} SELECT item_id, CAST(video AS BIGINT) AS video, kind, length FROM fi WHERE video % 5 <> 0")
def delete_items(spark, sf):
    items = C.media_items(spark, sf)
    return C.without_items(C.media_files(items), items.filter(F.col("video") % 5 == 0))


@query("edit_preference", f"WITH {ITEMS} SELECT CAST(video AS BIGINT) AS video, effect, CASE WHEN effect = 'ascii' THEN '{{\"n\":\"80\"}}' ELSE params END AS params FROM it")
def edit_preference(spark, sf):
    return C.edited_params(C.media_items(spark, sf), "ascii", "n", "80").select("video", "effect", "params")


@query("size_pick", "SELECT CAST(camera AS BIGINT) AS camera, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY abs(w - 1920) + abs(h - 1080), p_partkey) AS k FROM (SELECT p_size AS camera, p_partkey, 320 + p_partkey % 40 * 64 AS w, 240 + p_partkey % 23 * 60 AS h FROM part)) WHERE k = 1")
def size_pick(spark, sf):
    key = F.col("p_partkey")
    return C.best_size(table(spark, sf, "part").select(F.col("p_size").alias("camera"), key.alias("place"), (key % 40 * 64 + 320).alias("w"), (key % 23 * 60 + 240).alias("h")), 1920, 1080)


# Audio

AUDIO = "au AS (SELECT event_id // 2000 AS stream, event_id % 2000 AS idx, (event_id * 2654435761 + user_id * 97) % 65536 - 32768 AS s FROM events)"


def samples(spark, sf) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf, "events").select(F.floor(key / 2000).alias("stream"), F.pmod(key, F.lit(2000)).alias("idx"), (F.pmod(key * 2654435761 + F.col("user_id") * 97, F.lit(65536)) - 32768).alias("s"))


@query("audio_downmix", f"WITH {AUDIO} SELECT stream, CAST(idx // 3 AS BIGINT) AS idx, CAST(trunc(sum(s) / 3) AS BIGINT) AS s FROM au GROUP BY stream, idx // 3 HAVING count(*) = 3")
def audio_downmix(spark, sf):
    return A.downmix(samples(spark, sf), 3)


@query("audio_resample", f"""WITH {AUDIO}, a AS (SELECT stream, idx // 100 AS chunk, idx % 100 AS at, s FROM au), m AS (SELECT stream, chunk, count(*) AS n FROM a GROUP BY ALL),
o AS (SELECT stream, chunk, n, unnest(range(0, greatest(1, (n * 2 * 441 + 320) // 640))) AS i FROM m), p AS (SELECT *, least(n - 1, i * 320 // 441) AS k FROM o)
SELECT {big('p.stream p.chunk p.i').replace('AS p.', 'AS ')}, CAST(greatest(-32768, least(32767, floor((x.s * (441 - (i * 320 - k * 441)) + y.s * (i * 320 - k * 441)) * 2 / (2 * 441) + 0.5e0))) AS BIGINT) AS s
FROM p JOIN a x ON x.stream = p.stream AND x.chunk = p.chunk AND x.at = k JOIN a y ON y.stream = p.stream AND y.chunk = p.chunk AND y.at = least(n - 1, k + 1)""")
def audio_resample(spark, sf):
    return A.resample(samples(spark, sf), 320, 441)


@query("pcm_offset", f"WITH {AUDIO} SELECT {big('stream idx s')} FROM au WHERE idx >= 44100 * 37 // 1000")
def pcm_offset(spark, sf):
    return A.from_offset(samples(spark, sf), 37)


@query("audio_start", "SELECT event_id, CAST(CASE WHEN a >= 0 AND v >= 0 THEN greatest(0, a - v) // 1000 ELSE 0 END AS BIGINT) AS start_ms, CAST(44100 * event_id // 1000 * 2 AS BIGINT) AS at FROM (SELECT event_id, event_id * 3571 % 100003 - 500 AS a, user_id * 7907 % 50021 - 300 AS v FROM events)")
def audio_start(spark, sf):
    key = F.col("event_id")
    return table(spark, sf, "events").select("event_id", A.start_offset(key * 3571 % 100003 - 500, F.col("user_id") * 7907 % 50021 - 300).alias("start_ms"), N.pcm_byte_offset("event_id").alias("at"))


# Bytes

_val = lambda i: f"((strpos('0123456789ABCDEF', substr(d, CAST(2 * ({i}) + 1 AS INTEGER), 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(d, CAST(2 * ({i}) + 2 AS INTEGER), 1)) - 1)"
# texts' digits are cut into records once, so that long texts cost no more a byte
_cut = lambda n: f"wh AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '.{{{2 * n}}}') AS c FROM documents WHERE text IS NOT NULL), pc AS (SELECT doc_id, unnest(c) AS d, unnest(range(0, len(c))) AS k FROM wh)"


def raw(spark, sf) -> DataFrame:
    """Whole texts, as bytes: a stand-in for raw files."""
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("raw"))


@query("stride_removal", f"WITH {_cut(1)} SELECT {big('doc_id')}, CAST(k % 12 // 2 AS BIGINT) AS x, CAST(k // 12 AS BIGINT) AS y, CAST({_val('0')} AS BIGINT) AS value FROM pc WHERE k % 12 < 8 AND k % 12 % 2 = 0")
def stride_removal(spark, sf):
    return R.without_strides(raw(spark, sf), 4, 12, 2)


@query("plane_slice", f"WITH {_cut(12)} SELECT {big('doc_id')}, CAST(k AS BIGINT) AS index, substr(d, 1, 16) AS yp, substr(d, 17, 4) AS up, substr(d, 21, 4) AS vp FROM pc")
def plane_slice(spark, sf):
    planes = R.from_raw(R.fixed_records(raw(spark, sf), 12), 4, 2)
    return planes.select("doc_id", "index", *[F.hex(c).alias(c) for c in ("yp", "up", "vp")])


@query("pcm_decode", f"WITH {_cut(2)}, w AS (SELECT doc_id, k AS idx, {_val('0')} + 256 * {_val('1')} AS v FROM pc) SELECT {big('doc_id idx')}, CAST(CASE WHEN v > 32767 THEN v - 65536 ELSE v END AS BIGINT) AS s FROM w")
def pcm_decode(spark, sf):
    return A.decode_pcm(raw(spark, sf))


for _name in ("stride_removal", "plane_slice", "pcm_decode"):  # older names
    QUERIES[f"{_name}_whole"], ORACLES[f"{_name}_whole"] = QUERIES[_name], ORACLES[_name]


_n = "n AS (SELECT event_id, (event_id * event_id * event_id * 31 + user_id) % 4398046511104 AS v FROM events)"


def some_number() -> Column:
    """v of the SQL; the cube of an id has more than 63 bits from some two millions on, so it is taken modulo 2**42 as it grows."""
    key = F.col("event_id")
    cube = N.product_modulo(N.product_modulo(key, key, 42), key, 42)
    return F.pmod(N.product_modulo(cube, F.lit(31), 42) + F.col("user_id"), F.lit(1 << 42))


@query("ebml_length", f"WITH {_n}, k AS (SELECT *, CASE WHEN v < 127 THEN 1 WHEN v < 16383 THEN 2 WHEN v < 2097151 THEN 3 WHEN v < 268435455 THEN 4 WHEN v < 34359738367 THEN 5 WHEN v < 4398046511103 THEN 6 ELSE 7 END AS z FROM n) SELECT event_id, CAST(v AS BIGINT) AS v, lpad(lower(hex(CAST(v + (1::BIGINT << (7 * z)) AS BIGINT))), 2 * z, '0') AS bytes FROM k")
def ebml_length(spark, sf):
    own = table(spark, sf, "events").select("event_id", some_number().alias("v"))
    coded = own.withColumn("bytes", N.ebml_length("v"))
    return coded.select("event_id", N.ebml_length_value("bytes").alias("v"), "bytes")  # the value as it is read back


@query("ebml_integer", f"WITH {_n}, h AS (SELECT event_id, lower(hex(CAST(v AS BIGINT))) AS d FROM n) SELECT event_id, CASE WHEN length(d) % 2 = 1 THEN '0' || d ELSE d END AS bytes FROM h")
def ebml_integer(spark, sf):
    return table(spark, sf, "events").select("event_id", N.ebml_integer(some_number()).alias("bytes"))
