"""Components of near copies from buckets: which texts hang together, without a list of pairs.

1. Each bucket has a hub; texts are verified against the hubs of their buckets, on the full sets. Verified links join texts to components; a bucket whose texts are
   all in one is settled. The rest choose other hubs, ROUNDS times in all: the least text, then the one that shares the most buckets with others, which is a template's base
   where variants of it are alike to the base alone, then one by a hash. A round costs a row for each text and bucket.
2. Buckets that aren't settled by then belong to their first hub's component, whose buckets together are a *unit*. Texts of other components
   (*strangers*) are compared with all of a unit in blocks of bounded size inside numpy, as differences from its base, and only links between components leave a
   task. Texts of the unit's own component are never compared with each other, nor are pairs ever listed.

What stays in proportion to the square of a number is the comparison of strangers: texts that share buckets and yet aren't linked, as exact components need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import release, stage, tidy
from .ngram_join import BLOCK, BLOCK_BYTES, SMALL_BLOCK, _differences, _overlaps, _verify, components, with_reference

ROUNDS = 3
_U = np.uint64
_MEET = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _meet(similarity: float):
    """One block of comparisons, a table of (unit, i, j, side, node, root, base, lacks, adds, diff) -> the (a, b) of components with a link between them."""

    def run(block: pa.Table) -> pa.Table:
        rows = block.sort_by("node").combine_chunks()
        side = rows["side"].to_numpy()
        at = [np.flatnonzero(side == s) for s in ((0, 0) if rows["i"][0].as_py() == rows["j"][0].as_py() else (0, 1))]
        if not len(at[0]) or not len(at[1]):
            return _MEET.empty_table()
        base, lacks, adds = (rows[c].to_numpy() for c in ("base", "lacks", "adds"))
        diff = [np.frombuffer(x.as_buffer(), _U) for x in rows["diff"].chunk(0)]
        size = base - lacks + adds
        same = base[0] - lacks[at[0]][:, None] - lacks[at[1]][None, :] + _overlaps(*[[diff[k] for k in part] for part in at])
        root = rows["root"].combine_chunks().dictionary_encode()
        code = root.indices.to_numpy()
        linked = (same >= similarity * (size[at[0]][:, None] + size[at[1]][None, :] - same) - 1e-6) & (code[at[0]][:, None] != code[at[1]][None, :])
        x, y = np.nonzero(linked)
        pairs = np.unique(np.stack([code[at[0][x]], code[at[1][y]]]), axis=1)
        return pa.table([root.dictionary.take(pa.array(p)) for p in pairs], schema=_MEET)

    return run


def linked_classes(tables: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) for the nodes with links: the components of links between texts that share a bucket of tables (node, bucket); sets: (node, grams) of all of them."""
    spark = tables.sparkSession
    none = spark.createDataFrame([], "node binary, root binary")
    roots, open_ = none, tables
    of = lambda df, column, to: df.join(roots.select(F.col("node").alias(column), F.col("root").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))
    first = None
    for k in range(ROUNDS):
        rank = F.struct(F.xxhash64("node", F.lit(k)) if k > 1 else -F.col("mates") if k else F.lit(0), "node")
        placed = of(open_, "node", "root")
        if k == 1:
            sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
            placed = placed.join(open_.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("mates")), "node")
        placed = stage(placed)
        hubs = placed.groupBy("bucket").agg(F.min(rank)["node"].alias("hub"), F.min_by("root", rank).alias("of"), F.min("root").alias("low"), F.max("root").alias("high"))
        hubs = stage(hubs.filter("low != high").select("bucket", "hub", "of"))
        # buckets with several components stay open, for the next round or the comparison of blocks
        open_ = stage(placed.join(hubs, "bucket").select("node", "bucket", "root", "hub", "of"))
        first = first if k else hubs.select("bucket", F.col("hub").alias("first"))
        pairs = open_.filter("root != of").select("node", "hub").distinct()
        open_ = open_.select("node", "bucket")
        edges = with_reference(pairs, sets, "hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), "grams", "of").mapInArrow(tidy(_verify(similarity)), "a binary, b binary")
        roots = _joined(roots, edges)
        release(placed)
    placed = stage(of(open_, "node", "root"))
    still = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    inside = placed.join(still, "bucket").join(first, "bucket").select("node", "root", F.col("first").alias("hub"))
    inside = stage(of(inside, "hub", "unit").select("node", "root", "unit").distinct())
    if inside.isEmpty():
        return roots
    apart = with_reference(inside.select("node", "unit"), sets, "unit").mapInArrow(tidy(_differences), "node binary, unit binary, base bigint, lacks bigint, adds bigint, diff binary")
    dealt = stage(of(apart, "node", "root").withColumn("own", F.col("root") == F.col("unit")))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    heavy = lambda c: F.ceil(F.sum(F.when(c, F.length("diff")).otherwise(0)) / BLOCK_BYTES)
    parts = lambda c: F.greatest(heavy(c), F.ceil(count(c) / BLOCK), F.least(F.lit(16), F.ceil(count(c) / SMALL_BLOCK))).cast("int")
    sums = stage(dealt.groupBy("unit").agg(parts(F.col("own")).alias("own_blocks"), parts(~F.col("own")).alias("blocks")).filter("blocks > 0"))
    # strangers' blocks come first and meet all blocks; those of the unit's own texts only these
    rich = dealt.join(sums, "unit")
    place = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("own"), F.col("own_blocks")).otherwise(F.col("blocks"))).cast("int")
    rich = rich.withColumn("at", place + F.when(F.col("own"), F.col("blocks")).otherwise(0))
    rich = rich.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") + F.when(F.col("own"), 0).otherwise(F.col("own_blocks")) - 1)))
    blocks = rich.select("unit", F.least("at", "k").alias("i"), F.greatest("at", "k").alias("j"), F.when(F.col("at") <= F.col("k"), 0).otherwise(1).alias("side"), "node", "root", "base", "lacks", "adds", "diff")
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit", "i", "j")
    return _joined(roots, blocks.groupBy("unit", "i", "j").applyInArrow(_meet(similarity), "a binary, b binary"))


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (node, root) after links (a, b) between nodes, a node that isn't in roots being its own root: those it joins, and their new roots."""
    root = lambda df, c: df.join(roots.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    links = stage(root(root(edges, "a"), "b").filter("a != b").distinct())
    if links.isEmpty():
        return roots
    top = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = top.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots.select("node"), "node", "left_anti")
    return stage(known.unionByName(fresh))
