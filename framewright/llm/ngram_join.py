"""N-gram Jaccard join by MinHash banding.

Two documents are linked if the sets of their five-word n-grams have a Jaccard similarity of 0.8 or more. Bands and
rows are chosen for a target recall at that similarity. The steps:

1. Documents with equal n-gram sets are one *text*; all that follows works on texts, so copies cost nothing more.
2. Texts are shuffled on their band hashes. Each bucket's least text is its hub; each text is verified against the hubs
   of its buckets, on the full n-gram sets, and verified links form clusters.
3. Each bucket belongs to its hub's cluster. The cluster's *base* is the text that shares the most buckets with others, such as a template among its
   variants. A cluster's texts, and strangers that share one of its buckets, are kept as what they lack of the base's set and have beside it. Texts that differ little from the base (*tight*
   ones) are linked to each other for certain, so these links are counted and never looked at: a million near copies of a template cost
   a million rows. The others (*loose*) are compared with all texts of the unit, on these differences, in blocks of bounded size
   inside numpy; only counts per text, and one link for two clusters that meet, leave a task. So every pair that shares a
   bucket is counted exactly once, and no list of pairs is ever made.
4. Clusters that meet are joined; a class is a connected component of links.

Tables that are joined stand by themselves (they are staged), so that Spark can split the rows of a hot key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import free_name, least_row, passed, release, small_batches, stage, tidy
from ._words import chunks, grams, mix64

#: Most texts in a block of comparisons, and most bytes of their differences, on average. Groups of some hundreds are cut
#: into smaller blocks, so that more tasks share them.
BLOCK, SMALL_BLOCK, BLOCK_BYTES = 512, 128, 16 << 20
_U = np.uint64


def bands_for(similarity: float, recall: float, rows: int = 6) -> int:
    """The least number of bands of ``rows`` MinHashes that finds a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def gram_sets(texts: pa.Array, n: int, lower: bool = False) -> Iterator[np.ndarray]:
    """The sorted set of hashed n-grams of each text (``lower``: A-Z as a-z); of a shorter one, its words as one n-gram; of none, an empty set."""
    for first, end, words in chunks(texts):
        hashes = words.hashes(lower)
        runs, bounds = grams(hashes, words.offset, n)
        for d in range(end - first):
            if bounds[d] < bounds[d + 1]:
                yield np.unique(runs[bounds[d] : bounds[d + 1]])
            else:
                own = hashes[words.offset[d] : words.offset[d + 1]]
                yield own[:0] if not len(own) else mix64(np.array([int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little")], _U))


def _min_hashes(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """n_hashes x sets; no set may be empty."""
    rng = np.random.default_rng(20)
    xor, odd = rng.integers(0, 1 << 32, n_hashes, np.uint32), rng.integers(0, 1 << 31, n_hashes, np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((n_hashes, len(sets)), np.uint32)
    first = 0
    while first < len(sets):  # some 64k n-grams at a time stay in the cache
        end, size = first, 0
        while end < len(sets) and (end == first or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        flat = (np.concatenate(sets[first:end]) >> _U(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : end - 1]])]).astype(np.int64)
        for k in range(n_hashes):
            h = flat ^ xor[k]
            h *= odd[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[k, first:end] = np.minimum.reduceat(h, at)
        first = end
    return out


def _signatures(n: int, n_bands: int, rows: int):
    """Arrow rows (id, text_hash, text) -> (id, text_hash, set_key, n_grams, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(gram_sets(batch.column(2), n))
            full = [k for k, s in enumerate(sets) if len(s)]
            bands = np.zeros((n_bands, len(full)), _U)
            if full:
                low = _min_hashes([sets[k] for k in full], n_bands * rows).astype(_U).reshape(n_bands, rows, len(full))
                bands += np.arange(1, n_bands + 1, dtype=_U)[:, None]
                for r in range(rows):
                    bands = mix64(bands * _U(0x9E3779B97F4A7C15) + low[:, r])
            size = np.zeros(len(sets) + 1, np.int32)
            size[1:][full] = n_bands
            keys = pa.array([_key_of(s) for s in sets], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(bands.T.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*map(passed, batch.columns[:2]), passed(keys), pa.array([len(s) for s in sets], pa.int64()), lists], ["id", "text_hash", "set_key", "n_grams", "bands"])

    return run


def _key_of(grams_set: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams_set.tobytes(), digest_size=16).digest() if len(grams_set) else None


def _sets(n: int):
    """Arrow rows (text) -> (node, grams): the text's n-gram set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            for s in gram_sets(batch.column(0), n):
                keys.append(_key_of(s))
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([passed(pa.array(keys, pa.binary())), pa.array(sets, pa.binary())], ["node", "grams"])

    return run


def _in_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values of two sorted sets that both have."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[1:][both[1:] == both[:-1]]


def _verify(similarity: float):
    """Arrow rows (a, b, grams of a, grams of b) -> the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            linked = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = np.frombuffer(left[k].as_buffer(), _U), np.frombuffer(right[k].as_buffer(), _U)
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                    same = len(_in_common(a, b))
                    linked[k] = same >= similarity * (len(a) + len(b) - same)
            yield batch.select([0, 1]).filter(pa.array(linked))

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow rows (node, unit, grams, grams of the unit's base) -> (node, unit, base, lacks, adds, diff).

    base, lacks, adds: how many n-grams the base has, how many of them the text lacks, how many it has beside them; diff: these as
    hashes, lacking ones told apart from added ones by the last bit.
    """
    for batch in batches:
        (base, lacks, adds), diff = np.zeros((3, batch.num_rows), np.int64), []
        for k in range(batch.num_rows):
            own, of = np.frombuffer(batch.column(2)[k].as_buffer(), _U), np.frombuffer(batch.column(3)[k].as_buffer(), _U)
            same = _in_common(own, of)
            gone, new = np.setdiff1d(of, same, assume_unique=True), np.setdiff1d(own, same, assume_unique=True)
            base[k], lacks[k], adds[k] = len(of), len(gone), len(new)
            diff.append(np.concatenate([mix64(gone) & ~_U(1), mix64(new) | _U(1)]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (base, lacks, adds)), pa.array(diff, pa.binary())], ["node", "unit", "base", "lacks", "adds", "diff"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all left with all right sets."""
    n_left, n_right = len(left), len(right)
    grams_, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut_at = sum(map(len, left))
    rows = np.repeat(np.arange(n_left), [len(s) for s in left])
    cols = np.repeat(np.arange(n_right), [len(s) for s in right])
    a, b = code[:cut_at], code[cut_at:]
    df_a, df_b = np.bincount(a, minlength=len(grams_)), np.bincount(b, minlength=len(grams_))
    shared = (df_a > 0) & (df_b > 0)
    # n-grams of many texts by matrix products, those of few through their pairs
    common = shared & (df_a * df_b > 64)
    out = np.zeros((n_left, n_right), np.float32)
    names = np.flatnonzero(common)
    for k in range(0, len(names), 4096):
        part = np.full(len(grams_), -1)
        part[names[k : k + 4096]] = np.arange(len(names[k : k + 4096]))
        x = np.zeros((n_left, len(names[k : k + 4096])), np.float32)
        y = np.zeros((n_right, len(names[k : k + 4096])), np.float32)
        at, to = part[a] >= 0, part[b] >= 0
        x[rows[at], part[a][at]] = 1
        y[cols[to], part[b][to]] = 1
        out += x @ y.T
    few = shared & ~common
    at, to = few[a], few[b]
    a, rows, b, cols = a[at], rows[at], b[to], cols[to]
    order = np.argsort(b, kind="stable")
    b, cols = b[order], cols[order]
    start, size = np.searchsorted(b, a), df_b[a]
    if len(a):
        pairs = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        np.add.at(out, (np.repeat(rows, size), cols[pairs]), 1)
    return out


_COUNTS = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("copies", pa.int64()), ("other", pa.binary())])


def _compare(similarity: float):
    """One block of comparisons, a table of (unit, i, j, side, node, cluster, units, copies, base, lacks, adds, diff) -> (node, links, copies, other).

    other is null but in rows that tell of a link between the node's cluster and another."""

    def run(block: pa.Table) -> pa.Table:
        rows = block.sort_by("node").combine_chunks()
        same_side = rows["i"][0].as_py() == rows["j"][0].as_py()
        side = rows["side"].to_numpy()
        at = [np.flatnonzero(side == s) for s in ((0, 0) if same_side else (0, 1))]
        if not len(at[0]) or not len(at[1]):
            return _COUNTS.empty_table()
        base, lacks, adds, copies = (rows[c].to_numpy() for c in ("base", "lacks", "adds", "copies"))
        diff = [np.frombuffer(x.as_buffer(), _U) for x in rows["diff"].chunk(0)]
        size = base - lacks + adds
        # what both have of the base is what neither lacks; beside it they share what both add
        same = base[0] - lacks[at[0]][:, None] - lacks[at[1]][None, :] + _overlaps(*[[diff[k] for k in part] for part in at])
        linked = same >= similarity * (size[at[0]][:, None] + size[at[1]][None, :] - same) - 1e-6
        if same_side:
            linked &= ~np.eye(len(at[0]), dtype=bool)
        # texts of several units may meet in each of them; the least unit that both are in counts the pair
        many = rows["units"].combine_chunks().value_lengths().to_numpy() > 1
        if many.any():
            unit, units = rows["unit"][0].as_py(), [frozenset(u) for u in rows["units"].to_pylist()]
            for x, y in zip(*np.nonzero(linked & many[at[0]][:, None] & many[at[1]][None, :])):
                if min(units[at[0][x]] & units[at[1][y]]) != unit:
                    linked[x, y] = False
        node, cluster = rows["node"].to_pylist(), rows["cluster"].to_pylist()
        found = [(node[k], n, c) for k, n, c in zip(at[0], linked.sum(1).tolist(), (linked @ copies[at[1]]).tolist())]
        if not same_side:
            found += [(node[k], n, c) for k, n, c in zip(at[1], linked.sum(0).tolist(), (copies[at[0]] @ linked).tolist())]
        code = rows["cluster"].combine_chunks().dictionary_encode().indices.to_numpy()
        apart = np.nonzero(linked & (code[at[0]][:, None] != code[at[1]][None, :]))
        meet = {(code[at[0][x]], code[at[1][y]]): (node[at[0][x]], cluster[at[1][y]]) for x, y in zip(*apart)}
        columns = [[f[k] for f in found] for k in range(3)]
        columns = [columns[0] + [m[0] for m in meet.values()], *(c + [0] * len(meet) for c in columns[1:]), [None] * len(found) + [m[1] for m in meet.values()]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)

    return run


#: A hot hub or base is met by so many texts in a task at most, on average.
SPREAD = 1024


def with_reference(rows: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """rows (node, key) with grams, the node's n-gram set, and of, that of key. A key's rows are dealt to parts by their number, and its set to each part."""
    parts = stage(rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("parts")))
    dealt = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts")).cast("int"))
    of = sets.select(F.col("node").alias(key), F.col("grams").alias("of")).join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.join(sets, "node").join(of.select(key, "part", "of"), [key, "part"]).select("node", key, "grams", "of")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of (a, b): root is the least node of the connected component.

    Each round gives every node the least root among its neighbours' and then its root's root, so the number of rounds
    is logarithmic for what occurs in practice; each is staged, so a lost executor costs one round, and the one before it goes.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "near").distinct())
    roots = stage(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        seen = both.join(roots.select(F.col("node").alias("near"), "root"), "near").groupBy("node").agg(F.min("root").alias("m"))
        low = roots.join(seen, "node").select("node", "root", F.least("root", "m").alias("low"))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("next"))
        new = stage(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("new"), "root"))
        release(roots)
        roots = new.select("node", F.col("new").alias("root"))
        if new.filter("new != root").isEmpty():
            release(both)
            return roots


def _texts(docs: DataFrame, id: str, text: str, n: int, n_bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs as (id, text_hash, text); each one's signature; and a row for each distinct n-gram set: node, least, row, copies, bands."""
    source = docs.select(docs[id].alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    signed = stage(source.mapInArrow(tidy(_signatures(n, n_bands, rows)), f"id {kind}, text_hash bigint, set_key binary, n_grams bigint, bands array<bigint>"))
    texts = signed.filter("set_key IS NOT NULL").groupBy(F.col("set_key").alias("node")).agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    return source, signed, stage(texts)


def _sets_of(source: DataFrame, texts: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """(node, grams): the sets of the nodes of shared, made from one document each."""
    wanted = texts.join(shared.select("node").distinct(), "node").select(F.col("row.id").alias("w"), F.col("row.text_hash").alias("text_hash"))
    members = source.join(wanted, (source["text_hash"] == wanted["text_hash"]) & source["id"].eqNullSafe(wanted["w"]), "left_semi")
    return stage(members.select("text").mapInArrow(tidy(_sets(n)), "node binary, grams binary").dropDuplicates(["node"]))


def ngram_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.9998, rows: int = 6) -> DataFrame:
    """One row per row of docs: id, text_hash, class_id, n_grams, n_copies, n_text_links, n_links, and chosen.

    chosen is true for one document of each class, that of the least id (null last), then of the least text hash.

    class_id: the least id in the connected component of links; n_grams: the size of the n-gram set; n_copies: rows with an
    equal set, itself included; n_text_links: other sets with a similarity of at least ``similarity``; n_links: other rows
    that it is linked to, copies included. Words are compared as they stand. A text of fewer than n words has all its words
    as its only n-gram. Null texts and texts without a word link to nothing: class_id is their own id. Repeated rows are
    copies of each other. Rows with a null id take part; a class whose ids are all null has a null class_id. Other columns
    of docs are ignored. Pairs at exactly ``similarity`` are found with a probability of ``recall``, others with a higher one.
    """
    small_batches(docs.sparkSession)
    source, signed, texts = _texts(docs, id, text, n, bands_for(similarity, recall, rows), rows)

    banded = texts.select("node", F.explode("bands").alias("band"))
    buckets = stage(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    shared = stage(banded.join(buckets, "band").groupBy("node", "hub").agg(F.sum("size").alias("mates")))  # a row for each text and hub
    release(buckets)

    sets = _sets_of(source, texts, shared, n)

    pairs = with_reference(shared.filter("node != hub"), sets, "hub")
    edges = pairs.select(F.col("node").alias("a"), F.col("hub").alias("b"), "grams", "of").mapInArrow(tidy(_verify(similarity)), "a binary, b binary")
    roots = components(edges)

    cluster = lambda df, column: df.join(roots.select(F.col("node").alias(column), "root"), column, "left").withColumn("root", F.coalesce("root", column))
    inside = stage(cluster(shared.select("node", "hub"), "hub").select("node", F.col("root").alias("unit")).distinct())
    units = inside.groupBy("node").agg(F.collect_list("unit").alias("units"))  # a unit for each band at most
    mates = cluster(shared.groupBy("node").agg(F.sum("mates").alias("mates")), "node")
    bases = stage(mates.groupBy(F.col("root").alias("unit")).agg(F.max_by("node", F.struct("mates", "node")).alias("of_unit")))
    apart = with_reference(inside.join(bases, "unit").select("node", "of_unit"), sets, "of_unit").mapInArrow(tidy(_differences), "node binary, of_unit binary, base bigint, lacks bigint, adds bigint, diff binary")
    apart = apart.join(bases, "of_unit").drop("of_unit")
    # two tight texts have base - lacks - lacks in common at least, and base + adds + adds together at most
    tight = (F.size("units") == 1) & (F.col("lacks") + similarity * F.col("adds") <= (1 - similarity) / 2 * F.col("base") - 1e-6)
    dealt = cluster(apart.join(units, "node"), "node").join(texts.select("node", "copies"), "node").withColumn("tight", tight).withColumnRenamed("root", "cluster")
    dealt = stage(dealt)
    release(sets)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    heavy = lambda c: F.ceil(F.sum(F.when(c, F.length("diff")).otherwise(0)) / BLOCK_BYTES)
    sums = dealt.groupBy("unit").agg(count(F.col("tight")).alias("n_tight"), F.sum(F.when(F.col("tight"), F.col("copies")).otherwise(0)).alias("tight_copies"), count(~F.col("tight")).alias("n_loose"), heavy(F.col("tight")).alias("h_tight"), heavy(~F.col("tight")).alias("h_loose"))
    parts = lambda size, weight: F.greatest(weight, F.ceil(size / BLOCK), F.least(F.lit(16), F.ceil(size / SMALL_BLOCK))).cast("int")
    sums = stage(sums.select("unit", "n_tight", "tight_copies", parts(F.col("n_loose"), F.col("h_loose")).alias("loose_blocks"), parts(F.col("n_tight"), F.col("h_tight")).alias("tight_blocks")))

    # blocks of loose texts come first; they meet all blocks, and those of tight ones only these
    rich = dealt.join(sums, "unit").filter("loose_blocks > 0")
    place = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("tight"), F.col("tight_blocks")).otherwise(F.col("loose_blocks"))).cast("int")
    rich = rich.withColumn("own", place + F.when(F.col("tight"), F.col("loose_blocks")).otherwise(0))
    rich = rich.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("loose_blocks") + F.when(F.col("tight"), 0).otherwise(F.col("tight_blocks")) - 1)))
    blocks = rich.select("unit", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), F.when(F.col("own") <= F.col("k"), 0).otherwise(1).alias("side"), "node", "cluster", "units", "copies", "base", "lacks", "adds", "diff")
    # tasks by number, not by bytes: a small block may be much work
    blocks = blocks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit", "i", "j")
    found = stage(blocks.groupBy("unit", "i", "j").applyInArrow(_compare(similarity), "node binary, links bigint, copies bigint, other binary"))

    meet = cluster(found.filter("other IS NOT NULL").select("node", "other"), "node").select(F.col("root").alias("a"), F.col("other").alias("b"))
    meet = meet.union(dealt.filter("tight AND cluster != unit").select("cluster", "unit")).distinct()  # a tight text is linked to the base
    top = components(meet).select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = dealt.filter("tight").join(sums, "unit").select("node", (F.col("n_tight") - 1).alias("links"), (F.col("tight_copies") - F.col("copies")).alias("copies"))
    counts = found.select("node", "links", "copies").union(known).groupBy("node").agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    placed = cluster(texts.select("node", "least", "row", "copies"), "node").join(top, "root", "left").withColumn("top", F.coalesce("top", "root"))
    placed = stage(placed.join(counts, "node", "left"))
    least = stage(placed.groupBy("top").agg(F.min("least").alias("class_id"), F.min("row").alias("chosen")))
    done = stage(placed.join(least, "top").select(F.col("node").alias("set_key"), "class_id", "chosen", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked", F.lit(0)).alias("linked")))
    every = signed.filter("set_key IS NOT NULL").join(done, "set_key")
    chosen = F.col("id").eqNullSafe(F.col("chosen.id")) & (F.col("text_hash") == F.col("chosen.text_hash"))
    every = every.select("id", "text_hash", "class_id", "n_grams", F.col("copies").alias("n_copies"), F.col("links").alias("n_text_links"), (F.col("linked") + F.col("copies") - 1).alias("n_links"), chosen.alias("chosen"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    wordless = signed.filter("set_key IS NULL").select("id", "text_hash", F.col("id").alias("class_id"), "n_grams", one.alias("n_copies"), none.alias("n_text_links"), none.alias("n_links"), F.lit(True).alias("chosen"))
    return every.unionByName(wordless)


def ngram_join(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of docs: its id, class_id, n_grams, n_copies, n_text_links, n_links, as ngram_classes() tells."""
    return ngram_classes(docs, id, text, **how).drop("text_hash", "chosen").withColumnRenamed("id", id)


def ngram_components(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.9998, rows: int = 6) -> DataFrame:
    """One row per row of docs: id, text_hash, class_id and chosen, as ngram_classes() tells, without the numbers of links.

    A class needs a link between components and not all links, so texts are compared with the hubs of their buckets, and in blocks only those
    that are of other components then: of a template's variants, whatever they differ by, all that share a component are never looked at.
    """
    from .near_classes import linked_classes

    small_batches(docs.sparkSession)
    source, signed, texts = _texts(docs, id, text, n, bands_for(similarity, recall, rows), rows)
    banded = texts.select("node", F.explode("bands").alias("bucket"))
    common = stage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket"))
    tables = stage(banded.join(common, "bucket"))
    release(common)
    roots = linked_classes(tables, _sets_of(source, texts, tables, n), similarity)
    placed = stage(texts.select("node", "least", "row").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = stage(placed.groupBy("root").agg(F.min("least").alias("class_id"), F.min("row").alias("chosen")))
    done = stage(placed.join(least, "root").select(F.col("node").alias("set_key"), "class_id", "chosen"))
    every = signed.filter("set_key IS NOT NULL").join(done, "set_key")
    chosen = F.col("id").eqNullSafe(F.col("chosen.id")) & (F.col("text_hash") == F.col("chosen.text_hash"))
    every = every.select("id", "text_hash", "class_id", chosen.alias("chosen"))
    return every.unionByName(signed.filter("set_key IS NULL").select("id", "text_hash", F.col("id").alias("class_id"), F.lit(True).alias("chosen")))


def one_of_each_class(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without near duplicates: one row of each class stays, with all its columns. Texts without a word stay, repeated rows but once.

    Of rows equal in id and text that differ in other columns, the one whose JSON form is least stays. Columns of docs may have any names.
    """
    key, found = free_name(docs, "text_hash"), free_name(docs, "found")
    kept = ngram_components(docs, id, text, **how).filter("chosen").groupBy(F.col("id").alias("w"), F.col("text_hash").alias("h")).agg(F.count(F.lit(1)).alias("times"))
    kept = stage(kept)
    own = docs.withColumn(key, F.xxhash64(docs[text]))
    here = lambda part: (own[key] == part["h"]) & own[id].eqNullSafe(part["w"])
    single, several = kept.filter("times = 1"), kept.filter("times > 1")
    out = own.join(single, here(single), "left_semi").select(*docs.columns)
    if several.isEmpty():
        return out
    repeated = least_row(own.join(several, here(several), "left_semi"), [id, key], {found: F.count(F.lit(1))})
    return out.unionByName(repeated.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the near-duplicate class and the links of every document."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
