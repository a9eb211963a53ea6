"""Fingerprints, language-model scores, importance resampling, language identification and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from framewright.llm import fingerprints as X
from framewright.llm import importance as I
from framewright.llm import language_id as G
from framewright.llm import lm_scoring as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def edited(texts):
    out = []
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        n = len(text) // 4
        out.append(text[: len(text) - n] + after[:n])
    return out


def test_fingerprints_of_small_table(spark, sf, plain):
    ids = sorted(plain)
    texts = [plain[i] or "" for i in ids]
    got = {r["doc_id"]: r for r in X.query(spark, sf).collect()}
    assert sorted(got) == ids
    prints = {}
    for i, text, new in zip(ids, texts, edited(texts)):
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert prints.setdefault(r["fingerprint"], text) == text
        if text == new:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    long = [got[i] for i, t in zip(ids, texts) if len(t) > 400]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.3


def test_fingerprints_of_edges(edges, nothing):
    assert X.fingerprints(edges).count() == edges.count()
    assert X.fingerprints(nothing).count() == 0
    single = X.fingerprints(edges.filter("doc_id = 3")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1


def test_likeness_against_true_shares():
    """near_* against the Jaccard similarity of all spans, and common extensions against a count of characters."""
    import random

    rng = random.Random(2)
    for size in (40, 100, 400, 3000):
        text = "".join(rng.choice("abcdefgh ") for _ in range(size))
        for kept in (0, 0.5, 0.75, 0.95, 1):
            n = int(size * kept)
            new = text[:n] + "".join(rng.choice("ijklmnop ") for _ in range(size - n))
            x, y = (X.PrefixHash(X.code_points(t)) for t in (text, new))
            width = X.SHORT_SPAN if size < X.BRIEF else X.SPAN
            a, b = ({t[k : k + width] for k in range(len(t) - width + 1)} for t in (text, new))
            near = X.likeness(X.fingerprint(x, X.sketches(x)), X.fingerprint(y, X.sketches(y)))
            assert abs(near - len(a & b) / len(a | b)) < 0.25
            common = next((k for k in range(size) if text[k] != new[k]), size)
            assert X.common_extension(x, 0, y, 0) == common
            again = X.PrefixHash(X.code_points(new), x, common)
            assert (again.one == y.one).all() and (again.two == y.two).all()
            assert (X.spans(again, X.SPAN, X.spans(x, X.SPAN), common) == X.spans(y, X.SPAN)).all()


def test_fingerprints_of_many_alike_and_of_any_id(spark):
    """A third of the rows are equal, ids are strings, some null; the next row of each is the right one."""
    rows = [(f"k{k:04d}" if k % 5 else None, f"text {k} " * (k % 9)) for k in range(600)] + [("k0300", "the same text")] * 300 + [(None, None)] * 100
    got = X.fingerprints(spark.createDataFrame(rows, "doc_id string, text string").repartition(5)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    places = sorted(r["n_chars"] for r in got)
    assert places == sorted(len(t or "") for _, t in rows)
    assert sum(r["near_next"] == 1 and r["common_next"] == 13 for r in got if r["doc_id"] == "k0300") >= 299


def test_prefix_hashes():
    x, y = (X.PrefixHash(X.code_points(t)) for t in ("abcabcabd", "xxabcabcé"))
    assert X.equal(x, 0, x, 3, 3) and not X.equal(x, 0, x, 6, 3)
    assert X.common_extension(x, 0, y, 2) == 6 and X.common_extension(x, 0, y, 0) == 0


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), None]


def check_scores(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)), 3)) for i, x in rows)
    got = S.lm_scores(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    return got


def test_scores_of_small_table(documents):
    got = check_scores(documents)
    mean = lambda c, held: sum(r[c] for r in got if r["held_out"] == held) / sum(r["n_tokens"] for r in got if r["held_out"] == held)
    assert mean("score", True) > mean("base_score", True) and mean("score", False) > mean("base_score", False)


def test_probabilities_add_to_one(spark, documents):
    """Over all words of the vocabulary, one unknown word in each class and the end, after any two words."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from framewright.llm._spark import stage

    source = documents.select("doc_id", F.lit(False).alias("held"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(S.ROUNDS)).cast("tinyint").alias("turn"), "text")
    columns = "chunk bigint, ids array<bigint>, held_out array<boolean>, turns array<tinyint>, n_tokens array<bigint>, tokens binary, keys binary, counts binary"
    chunked = stage(source.mapInArrow(S._chunks(pa.int64()), columns))
    totals = stage(chunked.select("chunk", "keys", "counts").mapInArrow(S._key_rows(True), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    model, n, v = S.train(chunked, totals)
    rows = totals.collect()
    keys, count = np.array([r["key"] for r in rows]).view(np.uint64), np.array([r["n"] for r in rows], float)
    # an unknown word of each class but the end's
    keys, count = np.concatenate([keys, np.arange(S.CLASSES - 1, dtype=np.uint64) | np.uint64(1 << 62)]), np.concatenate([count, np.zeros(S.CLASSES - 1)])
    assert count.sum() == n and (count > 0).sum() == v
    rng = np.random.default_rng(1)
    for before in rng.choice(keys, (5, 2)):
        total = 0.0
        cls_all, slot_all = (keys & np.uint64(S.CLASSES - 1)).astype(int), model.slots(keys)
        for c in np.unique(cls_all):
            own = keys[cls_all == c]
            first, second, cls = (x[..., 2:] for x in S.features(np.array([*before, own[0]]), np.zeros(3, int), model.rows))
            p = np.exp(S.log_class(model, first)[0, c])
            if c == S.END_CLASS:
                total += p
                continue
            q, slot, m = np.exp(S.log_slot(model, second, cls)[0]), slot_all[cls_all == c], count[cls_all == c]
            total += p * np.where(slot > 0, q[slot], q[0] * (m + 0.5) / 10 ** model.rest[c]).sum()
        assert abs(total - 1) < 1e-3


def test_scores_follow_from_the_tables(spark, documents):
    """A text's score, recomputed word by word from the model's tables in plain loops."""
    small = documents.filter("doc_id < 60")
    chunked, totals = S.prepared(small)
    model, n, v = S.train(chunked, totals)
    count = {r["key"] & (2**64 - 1): r["n"] for r in totals.collect()}
    slots = dict(zip(model.slot_keys.tolist(), model.slot_of.tolist()))
    row = lambda h: int(h) >> (64 - model.rows.bit_length() + 1)
    mix = lambda x: int(S.mix64(np.array([x % 2**64], np.uint64))[0])
    seed, edge = [int(x) for x in S._SEED], 0x5EED

    def keys_of(text):
        import pyarrow as pa

        for _, _, words in S.chunks(pa.array([text or ""])):
            return [*S.word_keys(words).tolist(), int(S.END_KEY)]

    def log_share(weights, at):
        top = max(weights)
        return (weights[at] - top) - math.log(sum(math.exp(w - top) for w in weights))

    got = {r["doc_id"]: r["score"] for r in S.lm_scores(small).collect()}
    for r in small.filter("length(text) < 700").limit(8).collect():
        keys, total = keys_of(r["text"]), 0.0
        for k, key in enumerate(keys):
            one, two = (keys[k - back] if k >= back else edge for back in (1, 2))
            cls = key % S.CLASSES
            a, b = mix(one ^ seed[0]), mix(two ^ seed[1])
            outer = (a, b, mix(a * 3 + b))
            inner = [mix(x + cls * s) for x, s in zip(outer, seed[2:])]
            total += log_share([float(model.class_bias[c]) + sum(float(model.w1[t * model.rows + row(x), c]) for t, x in enumerate(outer)) for c in range(S.CLASSES)], cls) / math.log(10)
            if key == int(S.END_KEY):
                continue
            slot = slots.get(key, 0)
            total += log_share([float(model.slot_bias[cls, c]) + sum(float(model.w2[t * model.rows + row(x), c]) for t, x in enumerate(inner)) for c in range(S.SLOTS)], slot) / math.log(10)
            if not slot:
                total += math.log10(count.get(key, 0) + 0.5) - model.rest[cls]
        assert abs(total - got[r["doc_id"]]) < 1e-3 * max(1, abs(total) / 100), (total, got[r["doc_id"]])


def test_tables_grow_with_tokens_and_say_where_they_stop(caplog):
    assert [S.rows_for(n) for n in (0, 10**6, 10**8, 10**10)] == [4096, 4096, 16384, 1 << 18]
    with caplog.at_level("WARNING"):
        assert S.rows_for(10**13) == S.MOST_ROWS and "most_rows" in caplog.text


def test_additions_of_rows():
    rng = np.random.default_rng(7)
    for n, size in ((300, 1000), (1 << 17, 500), (5, 64), (9, 1)):
        rows, values = rng.integers(0, n, size), rng.random((size, S.CLASSES), np.float32)
        want = np.zeros((n, S.CLASSES))
        for r, x in zip(rows, values):
            want[r] += x
        for add, order in ((S._add, np.arange(size)), (S._add_ordered, np.argsort(rows, kind="stable"))):
            table = np.zeros((n, S.CLASSES), np.float32)
            add(table, rows[order], values[order])
            assert np.allclose(table, want, atol=1e-4)
        table = np.zeros((n, S.CLASSES), np.float32)
        S._count(table, rows * S.CLASSES + 3)
        assert (table[:, 3] == np.bincount(rows, minlength=n)).all() and table.sum() == size


def test_tables_grow():
    keys, doc = np.arange(10, dtype=np.uint64) << np.uint64(40), np.zeros(10, int)
    for n in (S.LEAST_ROWS, S.MOST_ROWS):
        first, second, _ = S.features(keys, doc, n)
        assert 0 <= min(first.min(), second.min()) and max(first.max(), second.max()) < n


def test_scores_of_edges(edges, nothing):
    check_scores(edges)
    assert S.lm_scores(nothing).count() == 0


def test_importance_of_small_table(spark, sf, plain):
    got = I.query(spark, sf).orderBy("rank").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(plain)
    assert [r["rank"] for r in got] == list(range(len(got)))
    keys = [r["key"] for r in got]
    assert keys == sorted(keys, reverse=True)
    kept = [r["kept"] for r in got]
    assert kept == sorted(kept, reverse=True) and any(kept)
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    share = lambda good: np.mean([r["kept"] for r in got if labels.get(r["doc_id"]) is good])
    assert share(True) > share(False) + 0.4


def test_importance_against_brute_force(spark, sf, plain):
    """Ratios from counts of buckets in Python; keys, ranks and the kept share from these."""
    import pyarrow as pa

    from framewright.llm._words import chunks

    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in I.query(spark, sf).collect()}
    def grams(text):
        """The buckets of the text's words and of its pairs of words."""
        for _, _, words in chunks(pa.array([text or ""])):
            single, pair = I._buckets(words)
            lower = [w.encode().lower() for w in WORD.findall(text or "")]
            assert len(single) == len(lower) and len(dict(zip(lower, single.tolist()))) >= len(set(single.tolist()))
            return single.tolist() + pair[pair >= 0].tolist()

    raw, target = Counter(), Counter()
    for i, t in plain.items():
        raw.update(grams(t))
        if labels.get(i):
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    ratio = lambda g: math.log((target[g] + I.PSEUDO) / (raw[g] * m / n + I.PSEUDO))
    for i, t in plain.items():
        size = len(WORD.findall(t or ""))
        want = sum(map(ratio, grams(t)))
        assert got[i]["n_words"] == size
        assert abs(got[i]["log_importance"] - want) <= 1e-5 * abs(want) + 1e-2
        assert abs(got[i]["level"] - got[i]["log_importance"] * I.WINDOW / max(size, I.WINDOW)) < 1e-6
        noise = got[i]["key"] - I.SHARPNESS * got[i]["level"]
        assert -5 < noise < 40
    order = sorted(got.values(), key=lambda r: r["rank"])
    assert [r["key"] for r in order] == sorted((r["key"] for r in order), reverse=True)
    own = sorted((i for i in labels if i in got))
    share = I.keep_share(np.array([got[i]["level"] for i in own]), np.array([labels[i] for i in own]))
    assert [r["kept"] for r in order] == [r["rank"] < round(share * len(order)) for r in order]


def test_importance_of_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(5, True), (9, False), (None, True), (5, True)], "doc_id long, good boolean")
    assert I.importance_resampling(edges, labels).count() == edges.count()
    assert I.importance_resampling(edges, labels.filter("doc_id > 100")).count() == edges.count()
    assert I.importance_resampling(nothing, labels).count() == 0


def test_worst_window():
    value, offset = np.array([1.0, -2, 3, -4, 5, 1, 1]), np.array([0, 5, 7])
    assert I.worst_window(value, offset, 2).tolist() == [-1.0, 2.0]


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(6)
    for width, sizes in ((3, [0, 1, 4, 6]), (2, [5, 0, 7]), (1, [3])):
        offset = np.concatenate([[0], np.cumsum(sizes)])
        score = rng.normal(0, 4, (offset[-1], width)).astype(np.float32)
        path = G.viterbi(score, offset, 2.5)
        worth = lambda p, part: sum(part[k, x] for k, x in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))
        for lo, hi in zip(offset[:-1], offset[1:]):
            best = max((worth(p, score[lo:hi]) for p in itertools.product(range(width), repeat=hi - lo)), default=0)
            assert abs(worth(path[lo:hi].tolist(), score[lo:hi]) - best) < 1e-4


def test_letters_of_all_scripts():
    import sys

    import pyarrow as pa

    from framewright.llm._words import chunks

    texts = [chr(c) for c in range(0x21, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    letters = [x for _, _, w in chunks(pa.array(texts)) for x in G.scripts(w)[1].tolist()]
    assert letters == [int(t.isalpha()) for t in texts]


def test_any_letter_makes_a_language(spark):
    docs = [(k, t, "xx") for k, t in enumerate(["µ", "ª º", "々〆", "ⴀⴁ", "Ⱀⰰ", "12 ×", "abc"] * 3)]
    got = G.language_id(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] % 7 != 5} == {"xx"} and {r["lang_pred"] for r in got if r["doc_id"] % 7 == 5} == {"und"}


def test_many_languages():
    score = np.full((2, 300), -9.0, np.float32)
    score[:, 257] = 0
    assert G.viterbi(score, np.array([0, 2]), 1.0).tolist() == [257, 257]


def test_languages_of_small_table(spark, sf, documents):
    got = {r["doc_id"]: r for r in G.query(spark, sf).collect()}
    rows = {r["doc_id"]: r for r in documents.collect()}
    assert set(got) == set(rows)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in rows[i]["text"] or ""))
    right = [r["lang_pred"] == rows[i]["lang"] for i, r in got.items() if r["held_out"] and rows[i]["lang"] and r["lang_pred"] != "und"]
    assert np.mean(right) > 0.85


def test_languages_of_edges(edges, nothing):
    got = G.language_id(edges).collect()
    assert len(got) == edges.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert G.language_id(nothing).count() == 0


def test_pipeline_stages(spark, sf, documents):
    import corpus_pipeline as C

    docs, size = documents, documents.count()
    for name, apply in C.STAGES[:-1]:
        out = apply(spark, docs, sf)
        assert out.columns == documents.columns, name
        new = out.cache().count()
        assert 0 < new <= size or name == "mix of sources"
        docs, size = out, new
    drawn = Counter((r["doc_id"]) for r in docs.collect())
    assert max(drawn.values()) <= 2
    packed = C.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == drawn
