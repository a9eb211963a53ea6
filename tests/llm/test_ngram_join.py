import itertools
import re
from collections import Counter, defaultdict

from framewright.llm import ngram_join as J

from .conftest import near, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def gram_set(text):
    words = WORD.findall(text or "")
    return frozenset(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    """(class ids, links) of (id, text) rows."""
    sets = [gram_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            same = len(sets[a] & sets[b])
            if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    least = {k: min((i for i in ids if i is not None), default=None) for k, ids in members.items()}
    return [least[find(k)] for k in range(len(rows))], links


def check(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    classes, links = brute(rows)
    want = Counter((i, c, n) for (i, _), c, n in zip(rows, classes, links))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in J.ngram_join(docs).collect())
    assert got == want


def test_small_table_against_brute_force(spark, documents):
    check(spark, documents)


def test_edges(spark, edges):
    check(spark, edges)


def test_large_group_and_chain(spark):
    """A group of more near copies than a block holds, and a chain whose ends aren't linked."""
    base, step = prose(50, 25), prose(60, 12)
    rows = [(k, near(base, k)) for k in range(300)]
    for k in range(6):
        rows.append((1000 + k, step))
        step = near(step, 100 + k)
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_tight_and_loose_texts(spark):
    """Near copies with few and with many changes in one group, strangers that share half of it, and texts of two groups."""
    import random

    rng = random.Random(3)
    base, other = (" ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(200)).split(" ") for tag in "pq")
    rows = []
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([0, 1, 2, 3, 4, 5])):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    for k in range(30):
        rows.append((200 + k, " ".join(base[: 60 + 4 * k] + other[60 + 4 * k :])))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_recall_of_pairs_at_the_similarity(spark):
    """Pairs whose similarity is 0.80 to 0.82: nine of ten are found at least."""
    rows = []
    for k in range(150):
        words = [f"k{k}w{m}" for m in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:94], *[f"k{k}v{m}" for m in range(94, 104)]]))]
    sets = {i: gram_set(t) for i, t in rows}
    similar = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(150)]
    assert all(0.8 <= s <= 0.83 for s in similar)
    got = {r["doc_id"]: r["class_id"] for r in J.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(150)) >= 0.9 * 150


def test_one_of_alike_rows_is_the_same_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", f"v{k}") for k in range(6)] + [(2, "a b c d e f", "x")], "doc_id long, text string, h string")
    assert [J.one_of_each_class(docs.repartition(n)).collect() for n in (1, 4)] == [[(1, "a b c d e f", "v0")]] * 2


def test_blocks_do_not_change_counts(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL_BLOCK", 16)
    base = prose(70, 25)
    check(spark, spark.createDataFrame([(k, near(base, k)) for k in range(100)], "doc_id long, text string"))


def test_one_of_each_class(spark, edges):
    kept = J.one_of_each_class(edges)
    assert kept.columns == edges.columns
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    classes, _ = brute(rows)
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left[5] == 1 and left[6] == left[7] == left[8] == 0  # copies and near copies of 5
    assert left[0] == left[1] == left[2] == 1  # without a word
    assert left[40] == 2 and left[None] == 2  # repeated rows but once


def test_recall_and_empty(nothing):
    bands = J.bands_for(0.8, 0.9998, 6)
    assert 1 - (1 - 0.8**6) ** bands >= 0.9998 > 1 - (1 - 0.8**6) ** (bands - 1)
    assert J.ngram_join(nothing).count() == 0
    assert J.one_of_each_class(nothing).count() == 0


def test_components_without_counts(spark, edges, nothing, documents):
    """The classes and the chosen documents are those of the join that counts links."""
    from collections import Counter

    for docs in (edges, documents, nothing):
        rows = lambda df: Counter(tuple(r[c] for c in ("id", "text_hash", "class_id", "chosen")) for r in df.collect())
        assert rows(J.ngram_components(docs)) == rows(J.ngram_classes(docs))


def test_variants_of_a_base_cost_rows_in_proportion(spark, monkeypatch):
    """Texts that are alike to their base and not to each other: what is staged grows with their number, though each shares buckets with most others."""
    from pyspark.sql import functions as F

    from framewright.llm import near_classes as K

    # of 300 words every 62nd or so is another in each variant, so that 8 % of the runs of five words are lacking: 0.85 to the base, 0.73 to each other
    changed = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda slot: F.pmod(F.xxhash64("id", slot), F.lit(50)) + slot * 60)
    words = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda k: F.when((F.col("id") > 0) & F.array_contains(changed, k.cast("long")), F.concat(F.lit("v"), F.col("id"), F.lit("_"), k)).otherwise(F.concat(F.lit("w"), k)))
    total = {}
    for n in (2500, 10_000):
        rows, staged_ = [], K.stage

        def counted(df, **how):
            out = staged_(df, **how)
            rows.append(out.count())
            return out

        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text")).repartition(8)
        monkeypatch.setattr(K, "stage", counted)
        got = J.ngram_components(docs).agg(F.countDistinct("class_id"), F.min("class_id"), F.sum(F.col("chosen").cast("int"))).first()
        monkeypatch.setattr(K, "stage", staged_)
        assert tuple(got) == (1, 0, 1)
        total[n] = sum(rows)
    assert total[10_000] < 5 * total[2500]
