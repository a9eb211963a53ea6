"""Frame timelines: durations, presentation times, as-of and nearest joins, rates, interleaving, and rules that drop late frames.

A timeline is (video, frame, ms), a row per frame. Joins in time lay both tables on one line of time for each video, and a running value looks back or
ahead: no pair of rows is made. Lines of time are cut into slices, so a video may hold any share of all frames; only event_timeline(), which numbers frames
without slices, puts one video into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import table
from .slices import SLICE, Running, running, sliced


def by_time() -> WindowSpec:
    return Window.partitionBy("video").orderBy("ms", "event_id")


def in_order() -> WindowSpec:
    return Window.partitionBy("video").orderBy("frame")


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame, ms, event_id, event_type, value): the events of a user as the frames of a video."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "event_type", "value")
    return own.withColumn("frame", F.row_number().over(by_time()).cast("long") - 1)


def sliced_timeline(spark: SparkSession, sf_dir: str, slices: int | None = None) -> DataFrame:
    """event_timeline() in slices of (video, ms, event_id), for users with any share of the events. What goes by frame or time within videos goes on in these slices."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "event_type", "value")
    return running(sliced(own, "video", ["ms", "event_id"], slices), "video", ["ms", "event_id"], {"frame": Running("count", F.lit(1))})


def _slices(frames: DataFrame) -> DataFrame:
    """frames in slices by frame, if they aren't in slices yet."""
    return frames if SLICE in frames.columns else sliced(frames, "video", ["frame"])


def whole_division(x: Column, by: Column) -> Column:
    return F.floor(x / F.nullif(by, F.lit(0))).cast("long")


def video_summary(frames: DataFrame) -> DataFrame:
    """(video, n_frames, first_ms, last_ms, average_ms, total_ms). A video of one frame has average 0."""
    out = frames.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    span = F.col("last_ms") - F.col("first_ms")
    average = F.coalesce(whole_division(span, F.col("n_frames") - 1), F.lit(0).cast("long"))
    return out.withColumns({"average_ms": average, "total_ms": span + average})


def frame_durations(frames: DataFrame) -> DataFrame:
    """Adds duration_ms: the time to the next frame; the last frame lasts as long as the others on average."""
    own = running(_slices(frames), "video", ["frame"], {
        "__next": Running("last", F.col("ms"), back=True), "__n": Running("count", F.lit(1), whole=True),
        "__first": Running("min", F.col("ms"), whole=True), "__last": Running("max", F.col("ms"), whole=True),
    })
    average = F.coalesce(whole_division(F.col("__last") - F.col("__first"), F.col("__n") - 1), F.lit(0).cast("long"))
    return own.withColumn("duration_ms", F.coalesce(F.col("__next") - F.col("ms"), average)).drop("__next", "__n", "__first", "__last")


def frame_times(frames: DataFrame) -> DataFrame:
    """Adds pts_us: when each frame is shown, the sum of the durations before it."""
    # the durations before a frame add up to the time since the first one
    own = running(_slices(frames), "video", ["frame"], {"__first": Running("min", F.col("ms"), whole=True)})
    return own.withColumn("pts_us", (F.col("ms") - F.col("__first")) * 1000).drop("__first")


def next_frame(frames: DataFrame, elapsed: DataFrame) -> DataFrame:
    """(video, base, delta_ms, next): the first frame from base on whose time since base is greater than delta; the last if there is none.

    elapsed: (video, base, delta_ms). An as-of join forward: both tables are laid on one line of time, in slices, and a running value looks ahead
    to the next frame, so there is no pair.
    """
    start = frames.select("video", F.col("frame").alias("base"), F.col("ms").alias("base_ms"))
    asks = elapsed.join(start, ["video", "base"]).select("video", (F.col("base_ms") + F.col("delta_ms")).alias("at"), F.lit(1).alias("ask"), "base", "delta_ms", F.lit(None).cast("long").alias("frame"))
    line = frames.select("video", F.col("ms").alias("at"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("delta_ms"), "frame").unionByName(asks)
    # frames of the same time stand before the asks, so that only later ones follow
    place = ["at", "ask", "frame", "base", "delta_ms"]
    found = running(sliced(line, "video", place), "video", place, {"__next": Running("last", F.col("frame"), back=True), "__last": Running("max", F.col("frame"), whole=True)})
    return found.filter("ask = 1").select("video", "base", "delta_ms", F.coalesce("__next", "__last").alias("next"))


def sample_times(frames: DataFrame, step_ms: int) -> DataFrame:
    """(video, k, at_ms): times at a fixed step from the first frame, the end included."""
    span = frames.groupBy("video").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    each = span.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / step_ms))))
    return each.select("video", "k", (F.col("first") + F.col("k") * step_ms).alias("at_ms"))


def nearest_frame(frames: DataFrame, times: DataFrame) -> DataFrame:
    """(video, k, at_ms, frame): the frame nearest to each time; the earlier of two, and the lowest of equals."""
    asks = times.select("video", F.col("at_ms").alias("at"), F.lit(1).alias("ask"), "k", F.lit(None).cast("long").alias("frame"))
    lowest = frames.groupBy("video", F.col("ms").alias("at")).agg(F.min("frame").alias("frame"))
    line = lowest.select("video", "at", F.lit(0).alias("ask"), F.lit(None).cast("long").alias("k"), "frame").unionByName(asks)
    place = ["at", "ask", "k"]
    own = F.when(F.col("ask") == 0, F.struct("at", "frame"))
    # a time's frame stands before the asks for that time, so it is the one before them
    found = running(sliced(line, "video", place), "video", place, {"b": Running("last", own), "a": Running("last", own, back=True)}).filter("ask = 1")
    nearer = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("at") - F.col("b.at") <= F.col("a.at") - F.col("at")))
    return found.select("video", "k", F.col("at").alias("at_ms"), F.when(nearer, F.col("b.frame")).otherwise(F.col("a.frame")).alias("frame"))


def nearest_at_steps(frames: DataFrame, step_ms: int) -> DataFrame:
    """nearest_frame() of sample_times(): a frame finds the times between it and the next by arithmetic, so that times, which may be far more than frames, are neither sorted nor kept."""
    own = frames if SLICE in frames.columns else sliced(frames, "video", ["ms", "frame"])
    order = ["ms", "frame"]
    line = running(own.select("video", *order, SLICE), "video", order, {"__before": Running("last", F.col("ms"))})
    lowest = line.filter(F.col("__before").isNull() | (F.col("__before") < F.col("ms"))).drop("__before")  # of each time the first frame
    found = running(lowest, "video", order, {"__next": Running("last", F.struct("ms", "frame"), back=True), "__first": Running("min", F.col("ms"), whole=True)})
    # the numbers of the times from this frame on and before the next one; the last frame has its own time at most
    low = F.expr(f"(ms - __first + {step_ms - 1}) div {step_ms}")
    high = F.expr(f"(coalesce(__next.ms, ms + 1) - 1 - __first) div {step_ms}")
    each = found.withColumns({"__low": low, "__high": high}).filter("__low <= __high").withColumn("k", F.explode(F.sequence("__low", "__high")))
    at = F.col("__first") + F.col("k") * step_ms
    nearer = F.col("__next").isNull() | (at - F.col("ms") <= F.col("__next.ms") - at)
    return each.select("video", "k", at.alias("at_ms"), F.when(nearer, F.col("frame")).otherwise(F.col("__next.frame")).alias("frame"))


def rate_estimate(frames: DataFrame, first: int = 180, default: float = 30.0) -> DataFrame:
    """(video, fps): frames a second over the first so many; the default where that can't be told."""
    some = frames.filter(F.col("frame") < first).groupBy("video").agg(F.count(F.lit(1)).alias("n"), (F.max("ms") - F.min("ms")).alias("span"))
    return some.select("video", F.when((F.col("n") > 1) & (F.col("span") > 0), (F.col("n") - 1) * 1000.0 / F.col("span")).otherwise(default).alias("fps"))


def running_mean(frames: DataFrame, value: str, last: int = 10) -> DataFrame:
    """Adds mean: that of the last so many values, fewer at the beginning. The last rows before a slice are its guests, so that its first ones find them."""
    own = _slices(frames)
    back = Window.partitionBy("video", SLICE).orderBy(F.col("frame").desc())
    ends = own.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") < last).groupBy("video", SLICE).agg(F.collect_list(F.struct("frame", value)).alias("tail"))
    # so many slices have as many rows at least
    before = Window.partitionBy("video").orderBy(SLICE).rowsBetween(1 - last, -1)
    found = ends.select("video", SLICE, F.slice(F.sort_array(F.flatten(F.collect_list("tail").over(before)), asc=False), 1, last - 1).alias("g"))
    guests = found.select("video", SLICE, F.explode("g").alias("g")).select("video", SLICE, "g.*", F.lit(True).alias("__guest"))
    both = own.withColumn("__guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
    order = Window.partitionBy("video", SLICE).orderBy("frame").rowsBetween(1 - last, 0)
    return both.withColumn("mean", F.avg(value).over(order)).filter(~F.col("__guest")).drop("__guest")


def followed(pages: DataFrame, last_ms: int) -> DataFrame:
    """pages (video, number, at) with next_at: when the next page of the video begins; the last one's is last_ms after its own."""
    own = running(sliced(pages, "video", ["number"]), "video", ["number"], {"next_at": Running("last", F.col("at"), back=True)})
    return own.withColumn("next_at", F.coalesce("next_at", F.col("at") + last_ms)).drop(SLICE)


def interleaved(video: DataFrame, audio: DataFrame) -> DataFrame:
    """(video, place, kind, number, at): blocks by time; an audio page stands before the video blocks that its next page's time doesn't pass.

    video: (video, number, at); audio: (video, number, at, next_at). What is left of the audio follows the last video block.
    """
    both = video.select("video", F.lit("v").alias("kind"), "number", "at", F.col("at").alias("__by")).unionByName(audio.select("video", F.lit("a").alias("kind"), "number", "at", F.col("next_at").alias("__by")))
    order = ["__by", "kind", "number"]
    return running(sliced(both, "video", order), "video", order, {"place": Running("count", F.lit(1))}).drop("__by", SLICE)


def not_late(arrivals: DataFrame, by: str = "event_id", key: str = "video", ms: str = "ms") -> DataFrame:
    """The rows that are not older than one of the same key that came before them."""
    own = running(sliced(arrivals, key, [by]), key, [by], {"__latest": Running("max", F.col(ms))})
    return own.filter(F.col("__latest").isNull() | (F.col("__latest") <= F.col(ms))).drop("__latest", SLICE)


def latest(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key: what a queue that holds one frame hands on."""
    rest = [c for c in frames.columns if c not in keys]
    best = frames.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ms", "event_id")).alias("s"))
    return best.select(*keys, "s.*")
