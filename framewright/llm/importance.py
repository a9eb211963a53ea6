"""A quality classifier by importance resampling.

Two generative models over hashed words and word pairs, one of the target texts (labelled good) and one of all raw texts, give each
document an importance: the log of the ratio of its probabilities. Documents are then drawn without replacement by Gumbel top-k:
those with the k greatest sums of log importance and a Gumbel variable. As the log ratio of a text grows with its length, it is taken for
WINDOW words, so that long texts aren't drawn for their length; what the worst window of a text has is told beside it.

Counts have a fixed number of buckets and cover all documents. The labels are a bounded sample (LABELLED rows at most), which
also says how large a share to keep. Texts are never shuffled; the k-th key is found by ranks within ranges of keys.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import gathered, passed, positions, small_batches, stage
from ._words import Words, chunks, mix64

BUCKETS = 1 << 20
LABELLED = 50_000
#: One of so many rows picked for bounds is one, so that ranges are of about the same size.
EVEN = 8
WINDOW = 32
#: Pseudo-counts, in occurrences in the target texts, that draw rare buckets' ratios to one.
PSEUDO = 5.0
#: Log importances, for WINDOW words, are multiplied by this before the Gumbel variable is added.
SHARPNESS = 4.0
_U = np.uint64


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and of each pair of a word and the next (-1 at a document's last word)."""
    hashes = words.hashes(lower=True)
    single = (mix64(hashes + _U(1)) % _U(BUCKETS)).astype(np.int64)
    pair = np.full(len(hashes), -1)
    if len(hashes) > 1:
        pair[:-1] = (mix64(hashes[:-1] * _U(3) + hashes[1:]) % _U(BUCKETS)).astype(np.int64)
    ends = words.offset[1:]
    pair[ends[ends > 0] - 1] = -1
    return single, pair


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow rows (good, text) -> (bucket, raw, target)."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = np.asarray(batch.column(0))
        for lo, hi, words in chunks(batch.column(1)):
            single, pair = _buckets(words)
            own = np.repeat(good[lo:hi], words.count)
            for x, use in ((single, own), (pair[pair >= 0], own[pair >= 0])):
                raw += np.bincount(x, minlength=BUCKETS)
                if use.any():
                    target += np.bincount(x[use], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def worst_window(value: np.ndarray, offset: np.ndarray, size: int) -> np.ndarray:
    """The least sum of ``size`` successive values of each document; of a shorter one, its sum."""
    n = len(offset) - 1
    total = np.concatenate([[0.0], np.cumsum(value, dtype=float)])
    out = total[offset[1:]] - total[offset[:-1]]
    count = np.diff(offset)
    long = np.flatnonzero(count > size)
    if len(long):
        runs = count[long] - size + 1
        begin = np.cumsum(runs) - runs
        at = np.arange(runs.sum()) + np.repeat(offset[:-1][long] - begin, runs)
        out[long] = np.minimum.reduceat(total[at + size] - total[at], begin)
    return out if n else np.zeros(0)


def _weigh(ratio: np.ndarray):
    """Arrow rows (id, text_hash, label, text) -> (id, text_hash, label, n_words, log_importance, worst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in chunks(batch.column(3)):
                single, pair = _buckets(words)
                value = ratio[single] + np.where(pair >= 0, ratio[pair], 0.0)
                total = np.concatenate([[0.0], np.cumsum(value, dtype=float)])
                made = [pa.array(words.count), pa.array(total[words.offset[1:]] - total[words.offset[:-1]]), pa.array(worst_window(value, words.offset, WINDOW))]
                yield pa.RecordBatch.from_arrays([*(passed(c.slice(lo, hi - lo)) for c in batch.columns[:3]), *made], ["id", "text_hash", "label", "n_words", "log_importance", "worst"])

    return run


def keep_share(level: np.ndarray, good: np.ndarray) -> float:
    """The share of labelled rows above the threshold that tells good from other ones best (Youden's index)."""
    if not good.any() or good.all():
        return 1.0
    order = np.argsort(-level, kind="stable")
    hit = np.cumsum(good[order]) / good.sum() - np.cumsum(~good[order]) / (~good).sum()
    return (int(hit.argmax()) + 1) / len(level)


def importance_resampling(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", share: float | None = None, seed: int = 8) -> DataFrame:
    """A row for each row of docs: id, n_words, log_importance, level, worst, key, rank (from 0, by key), kept.

    labels has the id and good, a boolean; of LABELLED rows at most, those of the least id hashes; an id with several labels is
    good if all are. kept is true for the ``share`` of rows with the greatest keys, by default the share that suits the labels.
    log_importance is the whole text's, level what WINDOW words of it have on average (a shorter text's own), worst that of its worst WINDOW
    words; keys are made of level. Null and empty texts have no words and an importance of 0, as
    have all texts if no label is good. Keys depend on id, text and seed alone; rows equal in these are drawn one after another. Null
    ids match no label. Other columns are ignored; an empty table gives no rows.
    """
    spark = small_batches(docs.sparkSession)
    sample = labels.groupBy(F.col(id).alias("l_id")).agg(F.min(F.coalesce("good", F.lit(False))).alias("label")).filter("l_id IS NOT NULL").orderBy(F.xxhash64("l_id"), "l_id").limit(LABELLED)
    source = docs.select(docs[id].alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    source = source.join(F.broadcast(sample), source["id"] == sample["l_id"], "left")  # LABELLED rows
    counted = source.select(F.coalesce("label", F.lit(False)).alias("good"), "text")
    found = gathered(counted).mapInArrow(_count, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bucket = found["bucket"].to_numpy()
    raw[bucket], target[bucket] = found["raw"].to_numpy(), found["target"].to_numpy()
    del found
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log((target + PSEUDO) / (expected + PSEUDO)).astype(np.float32) if target.any() else np.zeros(BUCKETS, np.float32)
    table = spark.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _weigh(table.value)(batches)

    weighed = stage(source.select("id", "text_hash", "label", "text").mapInArrow(weigh, f"id {kind}, text_hash bigint, label boolean, n_words bigint, log_importance double, worst double"))
    # the sampled labels' documents, LABELLED of them unless ids repeat
    weighed = weighed.withColumn("level", F.col("log_importance") * WINDOW / F.greatest("n_words", F.lit(WINDOW)))
    labelled = weighed.filter("label IS NOT NULL").groupBy("id").agg(F.min("level").alias("level"), F.min("label").alias("label")).orderBy("id").toArrow()
    share = keep_share(labelled["level"].to_numpy(), labelled["label"].to_numpy()) if share is None else share
    n = weighed.count()
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weighed.withColumn("key", F.col("level") * SHARPNESS - F.log(-F.log(uniform)))
    # ranges of keys of about the square root of all rows each; rows of equal keys are told apart by a number of their own
    place = [F.col("key"), F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()).alias("number")]
    keyed = keyed.select("id", "text_hash", "n_words", "log_importance", "level", "worst", *place)
    every = max(1, math.isqrt(n) // EVEN)
    picked = keyed.filter(F.pmod(F.xxhash64(F.lit(seed + 2), "id", "text_hash", "number"), F.lit(every)) == 0).select("key", "number").toArrow()
    bounds = spark.sparkContext.broadcast(sorted(zip(picked["key"].to_pylist(), picked["number"].to_pylist()))[EVEN - 1 :: EVEN])

    @F.arrow_udf("int")
    def from_top(key: pa.Array, number: pa.Array) -> pa.Array:
        at = bounds.value
        return pa.array([len(at) - bisect.bisect_left(at, k) for k in zip(key.to_pylist(), number.to_pylist())], pa.int32())

    ranked = positions(keyed, [F.lit(0)], [F.col("key").desc(), F.col("number").desc()], from_top("key", "number"), len(bounds.value) + 1)
    return ranked.select(F.col("id").alias(id), "n_words", "log_importance", "level", "worst", "key", F.col("position").alias("rank"), (F.col("position") < round(share * n)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what importance resampling keeps of all documents; good are labels of quality 1 that aren't toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return importance_resampling(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), labels)
