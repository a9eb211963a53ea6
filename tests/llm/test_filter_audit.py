"""Filter interaction audit: against a plain count over documents for every order, and its SQL."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.llm import filter_audit as A

from .conftest import prose


def plainly(rows, labels):
    """{(part, order, step): measures}, by applying the filters one after another."""
    good, toxic = {k for k, q, _ in labels if q == 1} - {None}, {k for k, _, t in labels if t == 1} - {None}
    least, docs = {}, []
    for k, text, _ in rows:
        if k is not None:
            least[text or ""] = min(k, least.get(text or "", k))
    for k, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        docs.append((lang or "", k, failed | {"E": k is not None and least[text] < k}))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                lost, before = [d for d in left if d[2][f]], gone
                left, gone = [d for d in left if not d[2][f]], gone + lost
                shapley[part, f] += len(lost)
                alone = sum(d[2][f] and sum(d[2].values()) == 1 for d in own)
                out[part, "".join(order), step] = [len(left), len(lost), sum(d[2][f] for d in before), alone, sum(d[1] in good for d in lost), sum(d[1] in toxic for d in lost), f]
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def measured(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, n string").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.filter_audit(docs, told, A.standard_filters(F.coalesce(docs["text"], F.lit(""))), "E")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}


def test_audit_against_plain_counts(spark):
    long = prose(1, 60)
    texts = [None, "", " \t", long, long, prose(2, 60) + " #", "LOUD " * 250, "same word " * 150, prose(3, 40).upper(), prose(4, 3), prose(5, 50), "a\x0bb c $"]
    rows = [(k, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(texts)]
    rows += [(50, long, "fr"), (50, long, "fr"), (2, long, "fr"), (None, long, "en"), (None, None, "de"), (60, prose(5, 50), None)] + [(100 + k, long + " hot", "en") for k in range(30)]
    labels = [(k, k % 2, k % 3 % 2) for k in range(70)] + [(3, 1, 1), (50, None, None), (None, 1, 1)]
    assert measured(spark, rows, labels) == plainly(rows, labels)


def test_audit_of_small_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = plainly(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in A.query(spark, sf).collect()} == want
    assert len(want) % 600 == 0


def test_audit_of_edges(spark, edges, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    filters = A.standard_filters(F.coalesce(F.col("text"), F.lit("")))
    assert A.filter_audit(nothing, labels, filters, "E").count() == 0
    rows = [tuple(r) for r in edges.select("doc_id", "text", "lang").collect()]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in A.filter_audit(edges, labels, filters, "E").collect()}
    assert got == plainly(rows, [])


def test_zeta(spark):
    counts = [3, 1, 4, 1, 5, 9, 2, 6]
    got = spark.createDataFrame([(counts,)], "c array<long>").select(A.zeta(F.col("c"), 3)).first()[0]
    assert got == [sum(c for m, c in enumerate(counts) if m & ~u == 0) for u in range(8)]


def test_filters_have_letters(spark, nothing):
    with pytest.raises(ValueError):
        A.filter_audit(nothing, nothing, {"AB": F.lit(True)})
    one = spark.createDataFrame([(1, "x", "p"), (2, "y", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = A.filter_audit(one, labels, {"Z": F.col("text") == "x"}).orderBy("part").collect()
    assert [tuple(r) for r in got] == [("", "Z", 1, 1, 0, 0, 0, 0, 0, 0), ("p", "Z", 1, 0, 1, 0, 1, 1, 0, 1)]
