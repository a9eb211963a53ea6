"""Near-dedup by tensored banding: against all pairs, and its parts."""

import itertools
import random
import re

import numpy as np

from framewright.llm import minhash_dedup as D

from .conftest import near, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset({tuple(words)} if words else ())


def plainly(rows):
    """A list of (id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= 80 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    out = []
    for k, (id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((id, len(sets[k]), least, id == least))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def found(df, **how):
    return key([tuple(r) for r in D.near_duplicates(df, **how).collect()])


def test_small_table(spark, documents, plain):
    assert found(documents) == key(plainly(list(plain.items())))


def test_edges(edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    assert found(edges) == key(plainly(rows))
    assert D.near_duplicates(nothing).count() == 0 and {"doc_id", "n_shingles", "component_id", "kept"} == {*D.near_duplicates(nothing).columns}


def test_case_words_and_exact_threshold(spark):
    """Similarities of exactly 0.8 and just below it, texts of a word or two, white space and case."""
    words = [f"w{k}" for k in range(60)]
    # sets of 45 shingles each, 40 in common: 40 / 50
    at = [" ".join(words[:46]), " ".join([*words[:41], "x1", "x2", "x3", "x4", "x5"]), " ".join([*words[:40], "y1", "y2", "y3", "y4", "y5", "y6"])]
    rows = [*enumerate(at), (10, "One"), (11, "ONE\n"), (12, "one two"), (13, "one\x0btwo"), (14, "one two"), (15, "É x"), (16, "é x"), (17, None), (18, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == key(plainly(rows))
    got = {r[0]: r[2] for r in found(docs)}
    assert got[1] == 0 and got[2] == 2 and got[11] == 10 and got[13] == 12 and got[14] == 14 and got[16] == 16


def test_chains_rounds_and_blocks(spark):
    """Chains of small changes link ends that aren't alike; many variants that differ by much keep buckets open for all rounds and the blocks."""
    rng = random.Random(4)
    rows, text = [], prose(1, 30)
    for k in range(40):
        rows.append((1000 - k, text))
        words = text.split()
        for _ in range(9):
            words[rng.randrange(len(words))] = f"c{rng.random()}"
        text = " ".join(words)
    base = prose(2, 40).split()
    for k in range(160):  # a tenth of the words replaced: many pairs lie just beside the threshold
        words = [f"v{k}_{i}" if rng.random() < 0.045 + 0.02 * (k % 3) else w for i, w in enumerate(base)]
        rows.append((2000 + k, " ".join(words)))
    rows += [(3000 + k, near(prose(9, 20), k)) for k in range(30)] + [(4000 + k, prose(9, 20)) for k in range(5)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == key(plainly(rows))


def test_collections_and_recall():
    heads, tails = D.collections_for(0.8, 0.9998)
    miss = (1 - 0.8**D.HEAD) ** heads, (1 - 0.8**D.TAIL) ** tails
    assert (1 - miss[0]) * (1 - miss[1]) >= 0.9998
    assert heads * D.HEAD + tails * D.TAIL < (D.HEAD + D.TAIL) * heads * tails / 10
    # pairs at the threshold agree in a head and a tail about as often as that
    rng, hits = np.random.default_rng(6), 0
    for _ in range(150):
        both = rng.integers(0, 2**63, 180).astype(np.uint64)
        a, b = np.unique(both[:162]), np.unique(np.concatenate([both[:144], both[162:]]))
        low = D._min_hashes([a, b], heads * D.HEAD + tails * D.TAIL)
        x, y = D._folded(low[: heads * D.HEAD], heads, D.HEAD, 1), D._folded(low[heads * D.HEAD :], tails, D.TAIL, 1 << 20)
        hits += bool((x[:, 0] == x[:, 1]).any() and (y[:, 0] == y[:, 1]).any())
    assert hits >= 149


def test_text_ids_and_other_settings(spark):
    rows = [("b", prose(1)), ("a", prose(1)), ("c", prose(3)), (None, prose(1)), (None, prose(4))]
    docs = spark.createDataFrame(rows, "name string, body string")
    got = {r[0]: r[2:] for r in D.near_duplicates(docs, id="name", text="body", n=3, similarity=0.9).collect() if r[0]}
    assert got == {"b": ("a", False), "a": ("a", True), "c": ("c", True)}
