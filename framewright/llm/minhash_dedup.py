"""MinHash near-dedup by tensored banding.

Two documents are linked if the sets of their two-word shingles have a Jaccard similarity of 0.8 or more; a class is a connected component of links.

Tables of six MinHashes find the pairs. Their keys aren't hashed one by one: each is a pair of a *head* of four and a *tail* of two MinHashes, from two small
collections, so 17 heads and 10 tails (88 MinHashes) make 170 tables, where tables of their own would take 1,020. A pair is found if it
agrees in some head and some tail. Heads that one text alone has are dropped before they are combined, so that a text without near copies
costs a row for each head and no table.

1. Documents of equal shingle sets are one *text*; all that follows works on texts.
2. Texts that share a bucket are candidates; links are confirmed on full sets and joined to components by near_classes.py.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import passed, release, small_batches, stage, tidy
from ._words import mix64
from .near_classes import linked_classes
from .ngram_join import _key_of, _min_hashes, gram_sets

HEAD, TAIL = 4, 2
_U = np.uint64


def collections_for(similarity: float, recall: float, head: int = HEAD, tail: int = TAIL) -> tuple[int, int]:
    """The least numbers of heads and tails that find a pair of this similarity with this probability: fewest MinHashes, then fewest tables."""
    miss = lambda rows, n: (1 - similarity**rows) ** n
    best = None
    for heads in range(1, 400):
        if 1 - miss(head, heads) <= recall:
            continue
        tails = math.ceil(math.log(1 - recall / (1 - miss(head, heads))) / math.log(1 - similarity**tail))
        best = min(best or (math.inf,), (heads * head + tails * tail, heads * tails, heads, tails))
        if best[0] < heads * head:
            break
    return best[2:]


def _folded(low: np.ndarray, n: int, rows: int, salt: int) -> np.ndarray:
    """n keys of ``rows`` MinHashes each."""
    keys = np.zeros((n, low.shape[1]), _U) + np.arange(salt, salt + n, dtype=_U)[:, None]
    for k, own in enumerate(np.split(low.reshape(n, rows, -1), rows, axis=1)):
        keys = mix64(keys * _U(0x9E3779B97F4A7C15) + own[:, 0].astype(_U) + _U(k))
    return keys


def _signatures(n: int, heads: int, tails: int):
    """Arrow rows (id, text_hash, text) -> (id, text_hash, set_key, n_shingles, heads, tails)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(gram_sets(batch.column(2), n, lower=True))
            full = [k for k, s in enumerate(sets) if len(s)]
            lists = []
            low = _min_hashes([sets[k] for k in full], heads * HEAD + tails * TAIL) if full else np.zeros((heads * HEAD + tails * TAIL, 0), np.uint32)
            for count, own in ((heads, _folded(low[: heads * HEAD], heads, HEAD, 1)), (tails, _folded(low[heads * HEAD :], tails, TAIL, 1 << 20))):
                size = np.zeros(len(sets) + 1, np.int32)
                size[1:][full] = count
                lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(own.T.ravel().view(np.int64))))
            keys = passed(pa.array([_key_of(s) for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays([*map(passed, batch.columns[:2]), keys, pa.array([len(s) for s in sets], pa.int64()), *lists], ["id", "text_hash", "set_key", "n_shingles", "heads", "tails"])

    return run


def _sets(n: int):
    """Arrow rows (text) -> (node, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(gram_sets(batch.column(0), n, lower=True))
            yield pa.RecordBatch.from_arrays([passed(pa.array([_key_of(s) for s in sets], pa.binary())), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "grams"])

    return run


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 2, similarity: float = 0.8, recall: float = 0.9998) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Words are runs of characters other than space and 0x09-0x0D, A-Z as a-z. n_shingles: distinct runs of n words; of a text of fewer words, its words as
    one. component_id: the least id that links lead to, its own included; kept: whether that is its own. A null text or one without a
    word has no shingles and links to nothing. Repeated rows are copies of each other. Rows with a null id take part; a component whose ids are all null has
    a null component_id, and its rows are kept. Other columns of docs are ignored. An empty table gives no rows. Pairs at exactly ``similarity`` share a
    bucket with a probability of ``recall``, others with a higher one; links are confirmed on full sets.
    """
    small_batches(docs.sparkSession)
    heads, tails = collections_for(similarity, recall)
    source = docs.select(docs[id].alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    signed = stage(source.mapInArrow(tidy(_signatures(n, heads, tails)), f"id {kind}, text_hash bigint, set_key binary, n_shingles bigint, heads array<bigint>, tails array<bigint>"))
    texts = signed.filter("set_key IS NOT NULL").groupBy(F.col("set_key").alias("node")).agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("row"), F.first("heads").alias("heads"), F.first("tails").alias("tails"))
    texts = stage(texts)

    shared = lambda df, key: stage(df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(key))
    headed = texts.select("node", F.explode("heads").alias("head"))
    common = shared(headed, "head")
    headed = stage(headed.join(common, "head"))
    release(common)
    tabled = headed.join(texts.select("node", "tails"), "node").select("node", "head", F.explode("tails").alias("tail")).select("node", F.xxhash64("head", "tail").alias("bucket"))
    common = shared(tabled, "bucket")
    tables = stage(tabled.join(common, "bucket"))
    release(common)
    release(headed)

    wanted = texts.join(tables.select("node").distinct(), "node").select(F.col("row.id").alias("w"), F.col("row.text_hash").alias("text_hash"))
    members = source.join(wanted, (source["text_hash"] == wanted["text_hash"]) & source["id"].eqNullSafe(wanted["w"]), "left_semi")
    sets = stage(members.select("text").mapInArrow(tidy(_sets(n)), "node binary, grams binary").dropDuplicates(["node"]))
    roots = linked_classes(tables, sets, similarity)

    placed = stage(texts.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = stage(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    done = stage(placed.join(least, "root").select(F.col("node").alias("set_key"), "component_id"))
    every = signed.filter("set_key IS NOT NULL").join(done, "set_key").select("id", "n_shingles", "component_id")
    wordless = signed.filter("set_key IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = every.unionByName(wordless).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the component of near copies of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
