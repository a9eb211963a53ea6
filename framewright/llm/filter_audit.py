"""Filter interaction audit by a subset-zeta transform.

Each document's failures form a mask, one bit for each filter. Documents are counted by part and mask, at most 2**k rows a part
however many documents there are; the zeta transform over subsets turns these counts into the survivors of every set of filters. A step of
an order is then a difference of two neighbouring sets, for all documents and likewise for those with a label.

All of it is DataFrame functions. A text is read once and leaves its task as a hash and a mask; the filter "same as an earlier text" is
decided on hashes, pre-aggregated by text and part, so that a text with a third of all rows is a few rows.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import stage

SPACE = " \t\n\x0b\f\r"
COUNTS = ("n", "good", "toxic")


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and 0x09-0x0D; of a blank text an empty array."""
    solid = F.trim(text, F.lit(SPACE))
    return F.when(F.length(solid) == 0, F.array().cast("array<string>")).otherwise(F.split(solid, r"[\x20\x09-\x0D]+"))


def standard_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of the query on a text that isn't null."""
    own = words(text)
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(own) < 200, "B": 100 * F.size(F.array_distinct(own)) < 50 * F.size(own), "C": 100 * upper > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def counts_by_mask(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], repeated: str | None, id: str, text: str, part: str) -> DataFrame:
    """(part, mask, n, good, toxic): bit k of mask is set if a document fails filter k of ``filters`` in order, then ``repeated``."""
    bit = {f: 1 << k for k, f in enumerate([*filters, *([repeated] if repeated else [])])}
    mask = reduce(lambda a, b: a + b, [F.when(c, bit[f]).otherwise(0) for f, c in filters.items()], F.lit(0))
    whole = F.coalesce(docs[text], F.lit(""))
    seen = stage(docs.select(docs[id].alias("id"), F.coalesce(docs[part], F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("text"), mask.alias("mask")))
    # a document has one row of labels at most: repeated ones count if any of them says so
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long")
    known = labels.groupBy(F.col(labels.columns[0]).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    none = F.lit(0).cast("long")
    told = seen.filter("id IS NOT NULL").join(known, "id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    told = told.unionByName(seen.filter("id IS NULL").withColumns({"good": none, "toxic": none}))
    total = [F.sum(c).alias(c) for c in COUNTS]
    told = told.withColumn("n", F.lit(1).cast("long"))
    if not repeated:
        return told.groupBy("part", "mask").agg(*total)
    # rows of one text, part and id are one; those of the least id of a text are its first
    own = told.groupBy("text", "part", "mask", "id").agg(*total)
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *COUNTS)))
    unknown = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_0") for c in COUNTS]
    own = stage(own.groupBy("text", "part", "mask").agg(first.alias("first"), *total, *unknown))
    least = own.groupBy("text").agg(F.min("first.id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    own = own.join(least, "text", "left")
    is_first = F.col("least").isNull() | (F.col("first.id") == F.col("least"))
    stay = [(F.col(f"{c}_0") + F.when(is_first, F.coalesce(F.col("first")[c], none)).otherwise(0)).alias(c) for c in COUNTS]
    passing = own.select("part", "mask", *stay, *[F.col(c).alias(f"{c}_all") for c in COUNTS])
    kinds = F.array(F.struct("mask", *COUNTS), F.struct((F.col("mask") + bit[repeated]).alias("mask"), *[(F.col(f"{c}_all") - F.col(c)).alias(c) for c in COUNTS]))
    return passing.select("part", F.explode(kinds).alias("k")).select("part", "k.*").groupBy("part", "mask").agg(*total)


def zeta(counts: Column, k: int) -> Column:
    """From an array of 2**k counts by mask, the array of sums over all subsets of each mask: one sweep for each bit."""
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(k)]), counts, lambda sums, bit: F.transform(sums, lambda x, m: x + F.when(m.bitwiseAND(bit) > 0, F.get(sums, m - bit)).otherwise(0)))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], repeated: str | None = None, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: what the step's filter keeps, removes and costs in that order.

    ``filters``: a letter and a failure condition each, on columns of docs (a null condition passes); ``repeated``: the letter of one more filter,
    which fails texts equal to the text of any smaller id in docs, whether that one is removed or not. At most six filters, as all their orders
    are told. labels: a row for a document, its id first, with quality and toxic; repeated rows count if any says 1, documents without one as 0.

    part: the value of that column, an empty string where null. filter_order: the letters; step from 1. kept and removed: documents of the
    part after the step, and taken by it. redundant: those failing its filter that an earlier one took. unique_fails: those failing no other. good_lost,
    toxic_lost: taken ones with quality = 1, with toxic = 1. shapley: the filter's removed, added up over all orders.

    Null texts are empty. Repeated rows count one by one, and none of them is smaller than another. A null id has no label, isn't smaller than any
    and has none smaller. An empty table has no parts and gives no rows. Other columns of docs are ignored.
    """
    letters = [*filters, *([repeated] if repeated else [])]
    k = len(letters)
    if not 1 <= k <= 6 or len({*letters}) < k or any(len(f) != 1 for f in letters):
        raise ValueError("one to six filters, named by different letters")
    full = (1 << k) - 1
    counts = counts_by_mask(docs, labels, filters, repeated, id, text, part)
    at = lambda c: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(full + 1)])
    parts = counts.groupBy("part").agg(*[at(c).alias(c) for c in COUNTS])
    parts = parts.select("part", *[zeta(F.col(c), k).alias(c) for c in COUNTS])
    left = lambda c, removing: F.get(F.col(c), F.lit(full) - removing)  # noqa: E731  survivors of a set of filters: those whose mask is outside it
    # a filter comes after a set of s others in s! (k - 1 - s)! orders
    share = F.array(*[F.lit(math.factorial(m.bit_count()) * math.factorial(k - 1 - m.bit_count()) if m < full else 0).cast("long") for m in range(full + 1)])
    worth = lambda bit: F.aggregate(F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(m.bitwiseAND(F.lit(bit)) == 0, F.get(F.col("share"), m) * (left("n", m) - left("n", m + bit))).otherwise(0))
    parts = parts.withColumn("share", share).select("part", *COUNTS, F.array(*[worth(1 << b) for b in range(k)]).alias("worth"))

    orders = F.split(F.lit(" ".join("".join(o) for o in itertools.permutations(letters))), " ")
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    place = reduce(lambda c, x: c.when(own == x[1], x[0]), enumerate(letters[1:], 1), F.when(own == letters[0], 0))
    before = reduce(lambda a, b: a + b, [F.when(F.instr(earlier, f) > 0, 1 << b).otherwise(0) for b, f in enumerate(letters)])
    steps = steps.withColumns({"place": place, "before": before}).withColumn("bit", F.element_at(F.array(*[F.lit(1 << b) for b in range(k)]), F.col("place") + 1))
    lost = lambda c: left(c, F.col("before")) - left(c, F.col("before") + F.col("bit"))
    fails = left("n", F.lit(0)) - left("n", F.col("bit"))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        left("n", F.col("before") + F.col("bit")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        (left("n", F.lit(full) - F.col("bit")) - left("n", F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get(F.col("worth"), F.col("place")).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the five filters over all documents, by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return filter_audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"), standard_filters(F.coalesce(docs["text"], F.lit(""))), "E")


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
own AS (SELECT doc_id, text, part, least, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM docs),
told AS (SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, len(words) < 200 AS fa, 100 * len(list_distinct(words)) < 50 * len(words) AS fb, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS fc,
    regexp_matches(text, '[#$%&*|]') AS fd, coalesce(least < doc_id, false) AS fe, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM own LEFT JOIN told ON told.id = own.doc_id),
masks AS (
  SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(f, b)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT filter_order, s.step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
told_steps AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told_steps
"""
