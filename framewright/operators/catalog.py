"""The media catalog: items, their files, effects and exports, as tables; metadata as JSON that is read by schema with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import item_id
from .timeline import event_timeline

# The artefacts of an item, and the names of effects.
KINDS = ("photo_raw", "video_raw", "audio_raw", "thumbnail", "rendered", "exported")
EFFECTS = ("edge", "edge_luminance", "solid_color", "convolve3x3", "permute_color", "cartoon", "ascii", "matrix", "oil_painting", "stained_glass")

EFFECT_TYPE = "struct<name:string,params:string>"
META_SCHEMA = f"type string, effect {EFFECT_TYPE}, width int, height int, xFlipped boolean, yFlipped boolean, portrait boolean, timestamp bigint, frameTimestamps array<bigint>, audioStartTimestamp bigint, exportedEffects map<string,{EFFECT_TYPE}>"


def effect_of(key: Column) -> Column:
    return F.get(F.array(*[F.lit(e) for e in EFFECTS]), F.pmod(key, F.lit(len(EFFECTS))).cast("int"))


def media_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, video, type, timestamp, frame_timestamps, effect, params): an item for each user with events."""
    frames = event_timeline(spark, sf_dir)
    out = frames.groupBy("video").agg(F.min("ms").alias("timestamp"), F.transform(F.array_sort(F.collect_list(F.struct("frame", "ms"))), lambda s: s["ms"]).alias("frame_timestamps"))
    kind = F.when(F.size("frame_timestamps") > 1, "VIDEO").otherwise("IMAGE")
    params = F.concat(F.lit('{"n":'), F.pmod("video", F.lit(7)).cast("string"), F.lit("}"))
    return out.select(item_id("timestamp").alias("item_id"), "video", kind.alias("type"), "timestamp", "frame_timestamps", effect_of(F.col("video")).alias("effect"), params.alias("params"))


def media_files(items: DataFrame) -> DataFrame:
    """(item_id, video, kind, length): the files of items; sizes follow from the number of frames."""
    n = F.size("frame_timestamps")
    each = items.select("item_id", "video", n.alias("n"), F.posexplode(F.array(*[F.lit(k) for k in KINDS])).alias("k", "kind"))
    return each.filter(F.pmod(F.col("video") + F.col("k"), F.lit(3)) != 0).select("item_id", "video", "kind", (F.col("n") * (F.col("k") + 1) * 1500 + F.col("video")).cast("long").alias("length"))


def item_sizes(items: DataFrame, files: DataFrame) -> DataFrame:
    """(item_id, video, n_files, length): each item's files added up; an item without files has 0."""
    total = files.groupBy("item_id", "video").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("length"))
    out = items.select("item_id", "video").join(total, ["item_id", "video"], "left")
    return out.select("item_id", "video", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def listing(items: DataFrame) -> DataFrame:
    """(place, item_id, video, type, frames): newest first. Places come from a count of days, then of items within one, so no task has all items."""
    day = F.substring("item_id", 1, 10)
    by_day = items.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    later = by_day.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a day
    own = items.withColumn("day", day).join(later, "day")
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.col("item_id").desc(), "video")) + F.col("before") - 1
    return own.select(place.cast("long").alias("place"), "item_id", "video", "type", F.size("frame_timestamps").cast("long").alias("frames"))


def metadata_json(items: DataFrame) -> DataFrame:
    """(item_id, video, json): the metadata document of each item."""
    effect = F.struct(F.col("effect").alias("name"), F.col("params").alias("params"))
    doc = F.struct("type", effect.alias("effect"), F.lit(640).alias("width"), F.lit(360).alias("height"), "timestamp", F.col("frame_timestamps").alias("frameTimestamps"))
    return items.select("item_id", "video", F.to_json(doc).alias("json"))


def read_metadata(docs: DataFrame, json: str = "json") -> DataFrame:
    """Adds meta: the parsed document. What it lacks gets a default: IMAGE, no flips, no frames, sound from 0, no exports."""
    meta = F.from_json(json, META_SCHEMA)
    out = docs.withColumn("__m", meta)
    defaults = {"type": F.lit("IMAGE"), "xFlipped": F.lit(False), "yFlipped": F.lit(False), "portrait": F.lit(False), "frameTimestamps": F.array().cast("array<bigint>"), "audioStartTimestamp": F.lit(0).cast("long"), "exportedEffects": F.create_map().cast(f"map<string,{EFFECT_TYPE}>")}
    names = ["type", "effect", "width", "height", "xFlipped", "yFlipped", "portrait", "timestamp", "frameTimestamps", "audioStartTimestamp", "exportedEffects"]
    fields = [F.coalesce(F.col(f"__m.{n}"), defaults[n]).alias(n) if n in defaults else F.col(f"__m.{n}").alias(n) for n in names]
    return out.withColumn("meta", F.struct(*fields)).drop("__m")


def with_export(docs: DataFrame, kind: Column, effect: Column) -> DataFrame:
    """meta with one more exported effect, which takes the place of one of the same kind."""
    old = F.map_filter("meta.exportedEffects", lambda k, _: k != kind)
    return docs.withColumn("meta", F.col("meta").withField("exportedEffects", F.map_concat(old, F.create_map(kind, effect))))


def with_effect(docs: DataFrame, effect: Column) -> DataFrame:
    return docs.withColumn("meta", F.col("meta").withField("effect", effect))


def canonical_params(params: Column | str) -> Column:
    """Parameters with numbers in one form, so that 1 and 1.0 are equal, and keys in order."""
    read = F.from_json(params, "map<string,string>")
    number = lambda v: F.coalesce(v.try_cast("double").cast("string"), v)
    entries = F.array_sort(F.map_entries(read))
    return F.to_json(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), number(e["value"]).alias("v"))))


def valid_exports(items: DataFrame, files: DataFrame, exports: DataFrame) -> DataFrame:
    """(item_id, video, kind, valid): whether an export can be used again: its file is there and its effect equals the item's.

    exports: (item_id, video, kind, name, params)."""
    there = files.select("item_id", "video", "kind").withColumn("there", F.lit(True))
    own = items.select("item_id", "video", "effect", F.col("params").alias("own_params"))
    out = exports.join(own, ["item_id", "video"]).join(there, ["item_id", "video", "kind"], "left")
    same = (F.col("name") == F.col("effect")) & (canonical_params("params") == canonical_params("own_params"))
    return out.select("item_id", "video", "kind", (F.coalesce("there", F.lit(False)) & F.coalesce(same, F.lit(False))).alias("valid"))


def without_items(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of items that are not deleted."""
    return table.join(gone.select("item_id", "video"), ["item_id", "video"], "left_anti")


def lookup(prefs: Column, key: str, default: Column) -> Column:
    """A preference, or the default where it is missing."""
    return F.coalesce(F.element_at(prefs, F.lit(key)), default)


def edited_params(items: DataFrame, effect: str, key: str, value: str) -> DataFrame:
    """items whose effect is that of an edited preference get its new value; others stay."""
    params = F.to_json(F.map_concat(F.map_filter(F.from_json("params", "map<string,string>"), lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value))))
    return items.withColumn("params", F.when(F.col("effect") == effect, params).otherwise(F.col("params")))


def best_size(sizes: DataFrame, width: int, height: int) -> DataFrame:
    """(camera, w, h): the size nearest to the target by the sum of differences; the first listed of those that tie."""
    off = F.abs(F.col("w") - width) + F.abs(F.col("h") - height)
    best = sizes.groupBy("camera").agg(F.min_by(F.struct("w", "h"), F.struct(off.alias("off"), "place")).alias("s"))
    return best.select("camera", "s.*")
