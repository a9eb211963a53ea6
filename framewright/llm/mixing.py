"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words. A source's target is met by whole passes over its blocks and the start of one more
in a permuted order, which makes an exact quota of blocks for each source. The tree splits the quotas among output shards:
a node draws from a multivariate-hypergeometric distribution how many of each source's blocks go to its left half. A leaf
holds a disjoint range of each source's permuted blocks, and a shard shuffles its blocks locally.

Only one row a source (names and sizes) is brought to the driver. Blocks move as rows of a few numbers, never as texts; they
are ranked in cells of about the square root of their number, so neither a hot source nor a hot cell meets one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cells, free_name, least_row, positions, small, stage

WEIGHTS = (3.0, 1.0, 2.0)
FAN_OUT = 1024


@dataclass(frozen=True)
class Source:
    name: str | None
    weight: float
    size: int
    target: float


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[Source]:
    """The target of each source, sources by code point and null last, weights repeating.

    Together they get share * all sizes by weight; one that would exceed most * its size stops there, and the excess is shared
    by weight among the others until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return [Source(s, weight[s], sizes[s], target[s]) for s in names]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good ones, by inversion, for populations of any size.

    Probabilities relative to the most likely count follow from ratios of successive ones, twelve standard deviations to either
    side (as far as there are counts); what lies beyond is less than the steps of a uniform double. That is some millions of counts
    for 10**11 blocks.
    """
    total, low, high = good + bad, max(0, n - bad), min(good, n)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    wide = int(12 * math.sqrt(max(1.0, n * share * (1 - share) * (total - n) / max(1, total - 1)))) + 30
    low, high = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(low, high, dtype=float)  # from k to k + 1
    step = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    log = np.concatenate([[0.0], np.cumsum(step)])
    chance = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def _draw(rng: np.random.Generator, quotas: np.ndarray, n: int) -> np.ndarray:
    """How many of n draws without replacement fall to each quota: a multivariate hypergeometric draw, quota after quota."""
    out, left = np.zeros_like(quotas), int(quotas.sum())
    for k, q in enumerate(map(int, quotas)):
        out[k] = hypergeometric(rng, q, left - q, n)
        n, left = n - int(out[k]), left - q
    return out


def _split(lo: int, hi: int, quotas: np.ndarray, begin: np.ndarray, seed: int, stop: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """The nodes of ``stop`` shards or fewer below (lo, hi)."""
    if hi - lo <= stop:
        yield lo, hi, quotas.tolist(), begin.tolist()
        return
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])
    left = _draw(rng, quotas, int(quotas.sum()) * (mid - lo) // (hi - lo))
    yield from _split(lo, mid, left, begin, seed, stop)
    yield from _split(mid, hi, quotas - left, begin + left, seed, stop)


def shard_ranges(spark: SparkSession, quotas: list[int], n_shards: int, seed: int) -> DataFrame:
    """(shard, source_no, begin, end): the range of a source's draws that a shard gets; empty ranges are left out.

    The top of the tree is split in one task down to FAN_OUT nodes at most, the trees below them in parallel.
    """
    kind = "lo int, hi int, quotas array<bigint>, begin array<bigint>"

    def down(stop: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    nodes = _split(row.lo, row.hi, np.array(row.quotas, np.int64), np.array(row.begin, np.int64), seed, stop)
                    yield pd.DataFrame(list(nodes), columns=["lo", "hi", "quotas", "begin"])

        return run

    root = spark.createDataFrame([(0, n_shards, quotas, [0] * len(quotas))], kind)
    top = root.mapInPandas(down(max(1, n_shards // FAN_OUT)), kind)
    leaves = (top.repartition("lo") if n_shards > FAN_OUT else top).mapInPandas(down(1), kind)
    each = leaves.select(F.col("lo").alias("shard"), F.posexplode(F.arrays_zip("quotas", "begin")).alias("source_no", "r"))
    return each.select("shard", "source_no", F.col("r.begin").alias("begin"), (F.col("r.begin") + F.col("r.quotas")).alias("end")).filter("end > begin")


@dataclass(frozen=True)
class Mix:
    """blocks: a row for each block that a shard gets, (key columns, block, words, pass, shard, slot); documents: a row for each
    document, (key columns, size, source_size, target). The key is doc_id, source, text_hash and copy."""

    sources: list[Source]
    blocks: DataFrame
    documents: DataFrame


KEY = ["doc_id", "source", "text_hash", "copy"]


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block_words: int | None = 256, shard_words: int = 1 << 20, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 1) -> Mix:
    """Plans the mix of all rows of docs; block_words None takes whole documents as blocks.

    Sizes are numbers of words (null text: 0). Documents without a word are in ``documents`` and take no part. Rows equal in
    id, source and text are told apart by ``copy``, 0, 1, and so on. Null ids and the null source are values like any other. An
    empty table gives empty tables. The same rows give the same mix, whatever their order and partitions.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(docs[text], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(docs[id].alias("doc_id"), docs[source].cast("string").alias("source"), F.xxhash64(docs[text]).alias("text_hash"), words.alias("size"))
    rows = rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("n"))
    n_blocks = F.ceil(F.col("size") / block_words) if block_words else F.least(F.col("size"), F.lit(1))
    rows = stage(rows.withColumn("n_blocks", n_blocks.cast("int")))
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum(F.col("n_blocks") * F.col("n")).alias("blocks")).collect()
    plan = targets({r["source"]: r["size"] for r in found}, weights, share, most)
    n_blocks_of = {r["source"]: r["blocks"] for r in found}
    n_all = sum(n_blocks_of.values())

    named = spark.createDataFrame([(k, s.name, s.size, s.target) for k, s in enumerate(plan)], "source_no int, source_name string, source_size long, target double")
    documents = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    documents = documents.join(small(named, len(plan)), documents["source"].eqNullSafe(named["source_name"])).drop("source_name", "n")

    blocks = documents.filter("n_blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    size = F.col("size") if block_words is None else F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block").cast("long") * block_words)
    blocks = blocks.select("source_no", *KEY, "block", size.alias("words"), "source_size", "target")
    spread = F.xxhash64(F.lit(seed), "doc_id", "text_hash", "copy", "block")
    blocks = positions(blocks, [F.col("source_no")], [spread, *map(F.col, KEY), F.col("block")], F.xxhash64(F.lit(seed + 1), spread), cells(n_all, max(1, math.isqrt(n_all))), F.col("words"))
    whole = F.floor(F.col("target") / F.col("source_size")).cast("int")  # passes over all blocks; then those whose middle lies before what is left
    more = (F.col("weight_before") + F.col("words") / 2 <= F.col("target") - whole * F.col("source_size")) & (whole < most)
    blocks = stage(blocks.withColumn("takes", whole + more.cast("int")).filter("takes > 0"))

    passes = blocks.groupBy("source_no").agg(F.sum("takes").alias("quota"), F.sum(F.col("takes") * F.col("words")).alias("words")).collect()
    quotas = {r["source_no"]: r["quota"] for r in passes}
    quotas = [quotas.get(k, 0) for k in range(len(plan))]
    n_shards = max(1, round(sum(r["words"] for r in passes) / shard_words))
    sizes = spark.createDataFrame([(k, n_blocks_of[s.name], max(1, -(-quotas[k] // n_shards))) for k, s in enumerate(plan)], "source_no int, first_pass long, cell long")
    draws = blocks.join(small(sizes, len(plan)), "source_no").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("takes") - 1)))
    # pass 0 takes positions 0 to N - 1 of the permuted order, pass 1 goes on at N, so that ranges of draws are disjoint
    draws = draws.withColumn("draw", F.col("pass") * F.col("first_pass") + F.col("position")).withColumn("at", F.floor(F.col("draw") / F.col("cell")))
    ranges = shard_ranges(spark, quotas, n_shards, seed).join(small(sizes, len(plan)), "source_no")
    ranges = ranges.withColumn("at", F.explode(F.sequence(F.floor(F.col("begin") / F.col("cell")), F.floor((F.col("end") - 1) / F.col("cell"))))).select("source_no", "at", "shard", "begin", "end")
    dealt = draws.join(ranges, ["source_no", "at"]).filter("draw >= begin AND draw < end")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "source_no", "draw"), "source_no", "draw")
    dealt = dealt.withColumn("slot", F.row_number().over(local) - 1)
    return Mix(plan, dealt.select(*KEY, "block", "words", "pass", "shard", "slot"), documents.select(*KEY, "size", "source_size", "target"))


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs as the mix has them, with whole documents as blocks: a row for each time that one is drawn, with the columns of docs.

    Of rows equal in id, source and text, that of the least JSON form stands for all. Documents without a word are never drawn. Columns
    of docs may have any names.
    """
    planned = mix(docs, id, text, source, block_words=None, **how)
    key, times, copies = (free_name(docs, n) for n in ("text_hash", "times", "copies"))
    drawn = planned.blocks.groupBy("doc_id", "source", "text_hash").agg(F.count(F.lit(1)).cast("int").alias("n_drawn")).toDF("w", "from", "h", "n_drawn")
    drawn = stage(drawn)
    own = docs.withColumn(key, F.xxhash64(docs[text]))
    alike = planned.documents.filter("copy > 0").select(F.col("doc_id").alias("w"), F.col("source").alias("from"), F.col("text_hash").alias("h")).distinct()
    same = lambda part: (own[key] == part["h"]) & own[id].eqNullSafe(part["w"]) & own[source].cast("string").eqNullSafe(part["from"])
    if not alike.isEmpty():
        alike = stage(alike)
        several = least_row(own.join(alike, same(alike), "left_semi"), [id, source, key], {copies: F.count(F.lit(1))})
        own = own.join(alike, same(alike), "left_anti").unionByName(several.drop(copies))
    out = own.join(drawn, same(drawn)).select(*[own[c] for c in docs.columns], drawn["n_drawn"].alias(times))
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: what the mix takes of every document."""
    planned = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    taken = planned.blocks.groupBy(*KEY).agg(F.sum("words").alias("taken")).select(*[F.col(c).alias(f"t_{c}") for c in KEY], "taken")
    docs = planned.documents
    same = [docs[c].eqNullSafe(taken[f"t_{c}"]) for c in KEY]
    out = docs.join(taken, same[0] & same[1] & same[2] & same[3], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
