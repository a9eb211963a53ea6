"""Queries of files: what is written as photos, pictures, archives and EBML, and read back, equals the SQL of what went in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio as A
from ..operators import catalog as C
from ..operators import geometry as G
from ..operators import glyphs as L
from ..operators import timeline as T
from ..operators.planes import KERNELS, apply, resized, rgb_pixels
from ..session import scratch, staged, table
from ..sinks import files as X
from ..sinks import mux as M
from ..sinks.archive import zip_pieces
from ..sinks.commit import append_files, write_files
from ..sources import ebml as E
from ..sources import frames as R
from ..sources.raw_frames import frames_at, raw_frames
from ..streaming.arrivals import delivered
from ..streaming.recorder import recorder
from . import glyph, media, raster
from .common import EV, PX, big, map_sql, rgb_cte, rgb_sql, whole
from .media import AUDIO, ITEMS, TL, samples

W, H = R.EVENT_W, R.EVENT_H
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: whole(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def planes(spark, sf) -> DataFrame:
    return R.to_planes(R.event_pixels(spark, sf), W, H)


def through_parquet(spark, df: DataFrame) -> DataFrame:
    """df as a sink's table and read back."""
    return staged(df)


@query("photo_round_trip", f"WITH {PX} SELECT {big('frame_id x y yy uu vv')} FROM px")
def photo_round_trip(spark, sf):
    """Photos as gzipped planes beside their metadata, read back by the rule of lengths, and cut into planes again."""
    photos = through_parquet(spark, planes(spark, sf).select("frame_id", X.gzipped("yp", "up", "vp").alias("content")))
    raw = photos.select("frame_id", X.raw_bytes(F.col("content"), F.length("content")).alias("raw"))
    return R.to_pixels(R.from_raw(raw, W, H))


_VIDEO = "vi AS (SELECT *, frame_id // 4 AS video, frame_id % 4 AS number FROM px)"
RECORD = W * H + 2 * (-(-W // 2) * -(-H // 2))


def video_folder(spark, sf) -> str:
    """Videos of four frames, appended frame by frame to a raw file each."""
    own = planes(spark, sf).select(F.format_string("%012d.raw", F.floor(F.col("frame_id") / 4)).alias("name"), F.pmod("frame_id", F.lit(4)).alias("place"), F.concat("yp", "up", "vp").alias("content"))
    folder = scratch(spark, "videos")
    append_files(own, folder)
    return folder


def video_pixels(frames: DataFrame) -> DataFrame:
    video = F.regexp_extract("file", r"(\d+)\.raw$", 1).cast("long")
    px = R.to_pixels(R.from_raw(frames.withColumn("frame_id", video * 4 + F.col("frame")), W, H))
    return px.select(F.floor(F.col("frame_id") / 4).alias("video"), F.pmod("frame_id", F.lit(4)).alias("number"), "x", "y", "yy", "uu", "vv")


@query("video_append", f"WITH {PX}, {_VIDEO} SELECT {big('video number x y yy uu vv')} FROM vi")
def video_append(spark, sf):
    """Videos as frames one after another in one file; frame k is read at k times a frame's bytes."""
    return video_pixels(raw_frames(spark, video_folder(spark, sf), RECORD))


@query("video_frame_range", f"WITH {PX}, {_VIDEO} SELECT {big('video number x y yy uu vv')} FROM vi WHERE number BETWEEN 1 AND 2")
def video_frame_range(spark, sf):
    """Two frames out of the middle of each file, by ranges of bytes."""
    return video_pixels(raw_frames(spark, video_folder(spark, sf), RECORD, 1, 3))


_NEXT = f"WITH {TL}, {PX}, a AS (SELECT video, frame AS base, ms AS base_ms, event_id * 7919 % 900000 AS delta_ms FROM tl)"


@query("video_playback", f"""{_NEXT}, nx AS (SELECT video, base, coalesce((SELECT min(frame) FROM tl t WHERE t.video = a.video AND t.ms > a.base_ms + a.delta_ms), (SELECT max(frame) FROM tl t WHERE t.video = a.video)) AS next FROM a),
su AS (SELECT frame_id, sum(yy) AS luma FROM px GROUP BY frame_id), pl AS (SELECT nx.*, nx.video % (SELECT max(frame_id) // 4 + 1 FROM su) * 4 + next % 4 AS frame_id FROM nx)
SELECT {big('pl.video pl.base pl.next').replace('AS pl.', 'AS ')}, CAST(su.luma AS BIGINT) AS luma FROM pl LEFT JOIN su USING (frame_id)""")
def video_playback(spark, sf):
    """What a player shows that may skip frames: the next frame by elapsed time, fetched from its raw file; its luma summed up."""
    folder, frames = video_folder(spark, sf), T.sliced_timeline(spark, sf)
    shown = T.next_frame(frames, media.elapsed(frames))
    files = table(spark, sf, "events").agg(F.floor(F.floor(F.max("event_id") / (W * H)) / 4) + 1).first()[0]  # one number
    asks = shown.select("video", "base", "next", F.format_string(f"{folder}/%012d.raw", F.col("video") % files).alias("file"), (F.col("next") % 4).alias("frame"))
    fetched = frames_at(asks, RECORD)
    return fetched.select("video", "base", "next", R.byte_sum(F.substring("raw", 1, W * H)).alias("luma")).withColumn("luma", F.when(F.col("luma") > 0, F.col("luma")))




@query("png_round_trip", raster.ORACLES["edge_luminance"])
def png_round_trip(spark, sf):
    """Rendered frames as pictures in files of their own, read by binaryFile."""
    made, folder = X.png_files(apply(planes(spark, sf), KERNELS["edge_luminance"])), scratch(spark, "png")
    write_files(made.select(F.format_string("%012d.png", "frame_id").alias("name"), "content"), folder)
    found = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("frame_id"), "content")
    return rgb_pixels(X.png_frames(found, "frame_id"))


@query("picture_sampled", f"SELECT frame_id, x // 4 AS x, y // 4 AS y, r, g, b FROM ({raster.ORACLES['edge_luminance']}) WHERE x % 4 = 0 AND y % 4 = 0")
def picture_sampled(spark, sf):
    """Pictures decoded for a target of 20 x 12, a quarter of their size in either way."""
    made = X.png_files(apply(planes(spark, sf), KERNELS["edge_luminance"])).select("frame_id", "content")
    return rgb_pixels(X.png_sampled(through_parquet(spark, made), "frame_id", 20, 12))


SLICES = 3


@query("stream_recorder", f"""WITH fr AS (SELECT DISTINCT event_id // 1000 AS frame_id FROM events), sl AS (SELECT frame_id, frame_id // 4 AS video, n, CASE WHEN frame_id < n // 3 THEN 0 WHEN frame_id < n * 2 // 3 THEN 1 ELSE 2 END AS batch FROM fr, (SELECT max(frame_id) + 1 AS n FROM fr))
SELECT * FROM ({raster.ORACLES['edge_luminance']}) WHERE frame_id IN (SELECT max(frame_id) FROM sl GROUP BY video, batch)""")
def stream_recorder(spark, sf):
    """Frames that arrive in slices; the latest of each video goes through an effect into a photo, and the photos are read back."""
    folder = scratch(spark, "recorded")
    frames = planes(spark, sf).withColumn("video", F.floor(F.col("frame_id") / 4))
    delivered(frames, "frame_id", "video", "latest", lambda stream: recorder(stream, KERNELS["edge_luminance"], folder, scratch(spark, "state")), SLICES)
    found = spark.read.format("binaryFile").load(f"{folder}/photos").select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("frame_id"), "content")
    return rgb_pixels(X.png_frames(found, "frame_id"))


@query("frames_zip", f"WITH {PX}, {rgb_cte()}, {_VIDEO.replace('FROM px', 'FROM rgb')} SELECT {big('video')}, CAST(number AS BIGINT) AS place, '/v' || video || '/' || printf('%05d', number) || '.png' AS name, CAST(sum(r) AS BIGINT) AS reds, CAST(sum(g * (x + 1)) AS BIGINT) AS greens, CAST(sum(b * (y + 1)) AS BIGINT) AS blues FROM vi GROUP BY video, number")
def frames_zip(spark, sf):
    """An archive of pictures for each video; sums of its pictures' pixels, as they are read back."""
    from ..operators.planes import rgb_fixed

    made = X.png_files(apply(planes(spark, sf), lambda p: rgb_fixed(*p)))
    video, place = F.floor(F.col("frame_id") / 4), F.pmod("frame_id", F.lit(4))
    files = made.select(video.alias("video"), place.alias("place"), F.concat(F.lit("/v"), video, F.lit("/"), F.format_string("%05d", place), F.lit(".png")).alias("name"), "content")
    folder = scratch(spark, "zip")
    append_files(zip_pieces(files, "video").withColumn("name", F.format_string("%012d.zip", "video")), folder)
    archives = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"(\d+)\.zip$", 1).cast("long").alias("video"), "content")
    found = X.zip_entries(archives, "video")
    keyed = found.withColumn("at", F.col("video") * 100_000 + F.col("place"))
    px = rgb_pixels(X.png_frames(keyed, "at")).groupBy("frame_id").agg(F.sum("r").alias("reds"), F.sum(F.col("g") * (F.col("x") + 1)).alias("greens"), F.sum(F.col("b") * (F.col("y") + 1)).alias("blues"))
    return keyed.select("video", "place", "name", "at").join(px, F.col("at") == F.col("frame_id")).drop("at", "frame_id")


_small = raster.resize_sql("ev", "yy", W, H, 20, 12)


@query("thumbnails", f"WITH {EV}, {_small} SELECT {big('frame_id x y')}, {map_sql('yy', (0, 0, 0), (255, 255, 255))} FROM small")
def thumbnails(spark, sf):
    """Luma at a thumbnail's size, as pictures and back."""
    import numpy as np

    def kernel(p):
        return np.stack([resized(p, 20, 12)[0]] * 3)

    def sized(df):
        return df.withColumns({"width": F.lit(20), "height": F.lit(12)})

    made = X.png_files(sized(apply(planes(spark, sf), kernel)))
    return rgb_pixels(X.png_frames(through_parquet(spark, made.select("frame_id", "content")), "frame_id"))


_half = "hf AS (SELECT frame_id, x // 2 AS x, y // 2 AS y, uu, vv FROM px WHERE x % 2 = 0 AND y % 2 = 0)"
_HW, _HH = -(-W // 2), -(-H // 2)
_r, _g, _b = rgb_sql("s.yy", "a.uu", "b.vv")


@query("thumbnails_colour", f"WITH {PX}, {_half}, {_small}, {raster.resize_sql('hf', 'uu', _HW, _HH, 10, 6, 'su')}, {raster.resize_sql('hf', 'vv', _HW, _HH, 10, 6, 'sv')} SELECT {big('s.frame_id s.x s.y').replace('AS s.', 'AS ')}, {_r} AS r, {_g} AS g, {_b} AS b FROM small s JOIN su a ON a.frame_id = s.frame_id AND a.x = s.x // 2 AND a.y = s.y // 2 JOIN sv b ON b.frame_id = s.frame_id AND b.x = s.x // 2 AND b.y = s.y // 2")
def thumbnails_colour(spark, sf):
    """Luma at a thumbnail's size and chroma at half of it, as pictures in colour and back."""
    from ..operators.planes import rgb_fixed

    made = apply(planes(spark, sf), lambda p: rgb_fixed(*resized(p, 20, 12))).withColumns({"width": F.lit(20), "height": F.lit(12)})
    return rgb_pixels(X.png_frames(through_parquet(spark, X.png_files(made).select("frame_id", "content")), "frame_id"))


# EBML: a file for each video, with a block of sound for each of its events

_EB = TL + """, bl AS (SELECT video, frame, frame * 37 AS ms, printf('%016X', event_id) AS d FROM tl)"""
_HEX = lambda n: f"CASE WHEN length(hex({n})) % 2 = 1 THEN '0' || hex({n}) ELSE hex({n}) END"


def ebml_files(spark, sf) -> DataFrame:
    """(video, data): a file with a block of eight bytes for each event of a user, 37 ms apart."""
    frames = T.event_timeline(spark, sf)
    rows = frames.groupBy("video").agg(F.array_sort(F.collect_list(F.struct((F.col("frame") * 37).alias("t"), F.unhex(F.lpad(F.hex("event_id"), 16, "0")).alias("d")))).alias("b"))
    return rows.select("video", E.audio_file(F.col("video") + 1, F.lit(44100.0), F.col("b.t"), F.col("b.d")).alias("data"))


@query("ebml_elements", f"""WITH {_EB}, vd AS (SELECT DISTINCT video FROM tl),
fixed AS (SELECT * FROM (VALUES (0, 0, -1, '1a45dfa3', 'EBML'), (1, 1, 0, '4286', 'EBMLVersion'), (2, 1, 0, '4282', 'DocType'), (3, 0, -1, '18538067', 'Segment'), (4, 1, 3, '1549a966', 'Info'), (5, 2, 4, '2ad7b1', 'TimecodeScale'),
  (7, 1, 3, '1654ae6b', 'Tracks'), (8, 2, 7, 'ae', 'TrackEntry'), (9, 3, 8, 'd7', 'TrackNumber'), (10, 3, 8, '83', 'TrackType'), (11, 3, 8, '86', 'CodecID'), (12, 3, 8, 'e1', 'Audio'), (13, 4, 12, 'b5', 'SamplingFrequency'), (14, 4, 12, '9f', 'Channels')) f(place, depth, parent, id, name)),
val AS (SELECT video, place, depth, parent, id, name, CASE name WHEN 'EBMLVersion' THEN '01' WHEN 'DocType' THEN '7765626D' WHEN 'TimecodeScale' THEN '0F4240' WHEN 'TrackNumber' THEN {_HEX('video + 1')}
  WHEN 'TrackType' THEN '02' WHEN 'CodecID' THEN '415F564F52424953' WHEN 'SamplingFrequency' THEN '472C4400' WHEN 'Channels' THEN '02' END AS value FROM vd, fixed),
cl AS (SELECT video, frame // 800 AS c, ms FROM bl WHERE frame % 800 = 0),
clu AS (SELECT video, 15 + 802 * c AS place, 1 AS depth, 3 AS parent, '1f43b675' AS id, 'Cluster' AS name, NULL AS value FROM cl),
cod AS (SELECT video, 16 + 802 * c AS place, 2 AS depth, 15 + 802 * c AS parent, 'e7' AS id, 'Timecode' AS name, CASE WHEN ms = 0 THEN '00' ELSE {_HEX('ms')} END AS value FROM cl),
blk AS (SELECT video, 17 + 802 * (frame // 800) + frame % 800 AS place, 2 AS depth, 15 + 802 * (frame // 800) AS parent, 'a3' AS id, 'SimpleBlock' AS name, '81' || printf('%04X', frame % 800 * 37) || '80' || d AS value FROM bl)
SELECT {big('video place depth')}, CAST(nullif(parent, -1) AS BIGINT) AS parent, id, name, value FROM (SELECT * FROM val UNION ALL SELECT * FROM clu UNION ALL SELECT * FROM cod UNION ALL SELECT * FROM blk)""")
def ebml_elements(spark, sf):
    """Elements of the files, with names from the table of ids; the duration, a double, is checked by ebml_durations."""
    found = E.parse(through_parquet(spark, ebml_files(spark, sf)), "video")
    named = found.join(F.broadcast(E.element_ids(spark)), "id")  # some thirty rows
    return named.filter("name <> 'Duration'").select("video", "place", "depth", "parent", "id", "name", F.hex("value").alias("value"))


@query("ebml_durations", f"WITH {_EB} SELECT {big('video')}, CAST(max(ms) AS DOUBLE) AS ms, CAST(count(*) AS BIGINT) AS n_blocks, CAST(min(video) + 1 AS BIGINT) AS track FROM bl GROUP BY video")
def ebml_durations(spark, sf):
    """Floats and integers of elements, decoded."""
    import struct

    from pyspark.sql.types import DoubleType

    @F.arrow_udf(DoubleType())
    def float_value(data):
        import pyarrow as pa

        return pa.array([None if x is None else struct.unpack(">d" if len(x) == 8 else ">f", x)[0] for x in data.to_pylist()], pa.float64())

    found = E.parse(ebml_files(spark, sf), "video")
    of = lambda id, value: F.max(F.when(F.col("id") == id, value))
    rest = found.groupBy("video").agg(F.sum(F.when(F.col("id") == "a3", 1).otherwise(0)).alias("n_blocks"), of("d7", E.integer_value("value")).alias("track"), of("4489", F.col("value")).alias("ms"))
    return rest.filter(F.col("ms").isNotNull()).withColumn("ms", float_value("ms"))


# Muxing: a user's events in turn as pictures and as packets of sound, 37 ms apart; a page has three packets of up to 599 bytes

PER, SPAN_MS = 3, 2000


def to_mux(spark, sf) -> DataFrame:
    """The placed blocks of each video."""
    frames = T.sliced_timeline(spark, sf).select("video", "frame", (F.col("frame") * 37).alias("at"), "event_id")
    pictures = frames.filter("frame % 2 = 0").select("video", F.col("frame").alias("number"), "at", F.unhex(F.lpad(F.hex("event_id"), 16, "0")).alias("payload"))
    packet = F.unhex(F.repeat(F.lpad(F.hex(F.col("event_id") % 256), 2, "0"), (F.col("event_id") * 37 % 600).cast("int")))
    packets = frames.filter("frame % 2 = 1").select("video", F.floor(F.col("frame") / 2).alias("number"), "at", packet.alias("packet"))
    return M.placed(M.blocks(pictures, M.pages(packets, PER)), SPAN_MS)


def muxed(spark, sf) -> DataFrame:
    """(video, length, data): the files as they are read back."""
    folder = scratch(spark, "muxed")
    append_files(M.pieces(to_mux(spark, sf)).withColumn("name", F.format_string("%012d.webm", "video")), folder)
    found = spark.read.format("binaryFile").load(folder)
    return found.select(F.regexp_extract("path", r"(\d+)\.webm$", 1).cast("long").alias("video"), "length", F.col("content").alias("data"))


_MUX = TL + f""", ev2 AS (SELECT video, frame, event_id, frame * 37 AS "at" FROM tl), pk AS (SELECT video, frame // 2 // {PER} AS number, frame // 2 % {PER} AS k, "at", event_id, event_id * 37 % 600 AS n FROM ev2 WHERE frame % 2 = 1),
pg AS (SELECT video, number, min("at") AS "at", sum(n) AS n, count(*) AS packets, coalesce(sum(n // 255 + 1) FILTER (k < m), 0) AS sizes FROM (SELECT *, max(k) OVER (PARTITION BY video, number) AS m FROM pk) GROUP BY ALL),
bo AS (SELECT video, 'v' AS kind, frame AS number, "at", "at" AS by_, 8 AS payload FROM ev2 WHERE frame % 2 = 0 UNION ALL
  SELECT video, 'a', number, "at", coalesce(lead("at") OVER (PARTITION BY video ORDER BY number), "at" + 1000), n + CASE WHEN packets > 1 THEN 1 + sizes ELSE 0 END FROM pg),
po AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY by_, kind, number) - 1 AS block FROM bo),
cu AS (SELECT *, CASE WHEN lag("at" // {SPAN_MS}) OVER (PARTITION BY video ORDER BY block) = "at" // {SPAN_MS} THEN 0 ELSE 1 END AS cut FROM po),
mb AS (SELECT *, sum(cut) OVER (PARTITION BY video ORDER BY block) - 1 AS cluster FROM cu)"""


@query("ebml_mux", f"""WITH {_MUX} SELECT {big('mb.video mb.block mb.cluster').replace('AS mb.', 'AS ')}, 1::BIGINT AS track, CAST(mb."at" AS BIGINT) AS "at", 0::BIGINT AS k, printf('%016X', event_id) AS packet FROM mb JOIN ev2 ON ev2.video = mb.video AND ev2.frame = mb.number WHERE kind = 'v'
UNION ALL SELECT {big('mb.video mb.block mb.cluster').replace('AS mb.', 'AS ')}, 2::BIGINT, CAST(mb."at" AS BIGINT), CAST(k AS BIGINT), repeat(printf('%02X', event_id % 256), CAST(pk.n AS BIGINT)) FROM mb JOIN pk ON pk.video = mb.video AND pk.number = mb.number WHERE kind = 'a'""")
def ebml_mux(spark, sf):
    """Muxed files parsed again: the packets of all blocks, with their clusters and times."""
    return M.packets(muxed(spark, sf)).withColumn("packet", F.hex("packet"))


_vlen = lambda n: f"CASE WHEN {n} < 127 THEN 1 WHEN {n} < 16383 THEN 2 WHEN {n} < 2097151 THEN 3 WHEN {n} < 268435455 THEN 4 ELSE 5 END"
_front = len(M.info(0.0) + M.TRACKS)


@query("ebml_mux_sizes", f"""WITH {_MUX}, bs AS (SELECT video, cluster, "at", payload + 4 AS s FROM mb), cs AS (SELECT video, cluster, min("at") AS t, sum(1 + ({_vlen('s')}) + s) AS n FROM bs GROUP BY ALL),
cc AS (SELECT video, cluster, 2 + CASE WHEN t < 256 THEN 1 WHEN t < 65536 THEN 2 WHEN t < 16777216 THEN 3 ELSE 4 END + n AS size FROM cs), ss AS (SELECT video, {_front} + sum(4 + ({_vlen('size')}) + size) AS size FROM cc GROUP BY video)
SELECT {big('video')}, -1::BIGINT AS cluster, CAST(size AS BIGINT) AS size, CAST({len(M.HEADER)} + 4 + ({_vlen('size')}) + size AS BIGINT) AS length FROM ss UNION ALL SELECT {big('video cluster size')}, NULL::BIGINT FROM cc""")
def ebml_mux_sizes(spark, sf):
    """The sizes that segments and clusters tell, and the files' own."""
    return M.sizes(muxed(spark, sf))


# Audio, sizes and the catalog

@query("mic_trim", f"WITH {AUDIO} SELECT CAST(stream AS BIGINT) AS stream, CAST(idx - 2205 AS BIGINT) AS idx, CAST(s AS BIGINT) AS s FROM (SELECT stream // 5 AS stream, stream % 5 * 2000 + idx AS idx, s FROM au) WHERE idx BETWEEN 2205 AND 2204 + 120 * 44100")
def mic_trim(spark, sf):
    """Recordings of 10,000 samples without what a microphone's start spoils."""
    own = samples(spark, sf).select(F.floor(F.col("stream") / 5).alias("stream"), (F.pmod("stream", F.lit(5)) * 2000 + F.col("idx")).alias("idx"), "s")
    return A.trimmed(own)


@query("pcm_round_trip", f"WITH {AUDIO} SELECT {big('stream idx s')}, CAST(s AS DOUBLE) / 32768e0 AS \"left\", CAST(s AS DOUBLE) / 32768e0 AS \"right\" FROM au")
def pcm_round_trip(spark, sf):
    return A.as_stereo_floats(A.decode_pcm(A.encode_pcm(samples(spark, sf))))


@query("page_times", f"WITH {AUDIO} SELECT CAST(stream AS BIGINT) AS stream, CAST(count(*) * 2 AS BIGINT) AS n_bytes, CAST(count(*) AS DOUBLE) / 44100e0 AS seconds FROM au GROUP BY stream")
def page_times(spark, sf):
    raw = A.encode_pcm(samples(spark, sf)).select("stream", F.length("raw").alias("n_bytes"))
    return raw.withColumn("seconds", A.page_seconds(F.col("n_bytes")))


_FITS = ((640, 360), (300, 500), (1920, 1080))


@query("letterbox_fit", " UNION ALL ".join(f"SELECT CAST(k AS BIGINT) AS k, {tw}::BIGINT AS to_w, CAST(({tw} - nw) // 2 AS BIGINT) AS x, CAST(({th} - nh) // 2 AS BIGINT) AS y, CAST(nw AS BIGINT) AS w, CAST(nh AS BIGINT) AS h FROM (SELECT k, CASE WHEN {tw} * h <= {th} * w THEN {tw} ELSE {th} * w // h END AS nw, CASE WHEN {tw} * h <= {th} * w THEN {tw} * h // w ELSE {th} END AS nh FROM (SELECT p_partkey AS k, 100 + p_size * 37 AS w, 100 + p_partkey % 91 * 13 AS h FROM part))" for tw, th in _FITS))
def letterbox_fit(spark, sf):
    own = raster.sizes(spark, sf)
    fits = [own.select("k", F.lit(to[0]).alias("to_w"), *[c.alias(n) for c, n in zip(G.letterbox_columns(F.col("w"), F.col("h"), *to), ("x", "y", "w", "h"))]) for to in _FITS]
    return fits[0].unionByName(fits[1]).unionByName(fits[2])


@query("effect_change", f"WITH {ITEMS} SELECT item_id, CAST(video AS BIGINT) AS video, CASE WHEN video % 3 = 0 THEN 'ascii' ELSE effect END AS effect, CASE WHEN video % 3 = 0 THEN '{{\"numColumns\":80}}' ELSE params END AS params, CAST(CASE WHEN video % 3 = 0 THEN 80 ELSE 120 END AS BIGINT) AS columns FROM it")
def effect_change(spark, sf):
    """Every third item gets another effect; the number of columns is looked up in its parameters, 120 where they don't say."""
    docs = C.read_metadata(C.metadata_json(C.media_items(spark, sf)))
    other = F.struct(F.lit("ascii").alias("name"), F.lit('{"numColumns":80}').alias("params"))
    changed = C.with_effect(docs, F.when(F.col("video") % 3 == 0, other).otherwise(F.col("meta.effect")))
    prefs = F.from_json("meta.effect.params", "map<string,string>")
    return changed.select("item_id", "video", F.col("meta.effect.name").alias("effect"), F.col("meta.effect.params").alias("params"), C.lookup(prefs, "numColumns", F.lit("120")).cast("long").alias("columns"))


_rows = glyph.ORACLES["ascii_html_runs"]


@query("html_pages", f"SELECT frame_id, '{L.PAGE_HEAD.format(title='frame', background='#000000')}' || string_agg(html, chr(10) ORDER BY \"row\") || '{L.PAGE_END}' AS page FROM ({_rows}) GROUP BY frame_id")
def html_pages(spark, sf):
    own = L.cells(R.event_pixels(spark, sf), glyph.GRID, W, H, len(glyph.CHARS), "primary")
    return L.html_pages(own, glyph.CHARS, "frame")


@query("matrix_rain", f"""WITH rain AS ({glyph.ORACLES['raindrop_cells']}), cells AS ({glyph.ORACLES['matrix_base']}) SELECT c.frame_id, c."row", c.col, coalesce(r.r, c.r) AS r, coalesce(r.g, c.g) AS g, coalesce(r.b, c.b) AS b FROM cells c LEFT JOIN rain r ON r.frame_id = c.frame_id AND r."row" = c."row" AND r.col = c.col""")
def matrix_rain(spark, sf):
    """Falling drops in front of the cells' base colours."""
    base = L.rain_base(L.cell_means(R.event_pixels(spark, sf), glyph.GRID, W, H), (30, 255, 160))
    return L.rain_over(base, L.drop_cells(glyph.drops(spark, sf), 12))
