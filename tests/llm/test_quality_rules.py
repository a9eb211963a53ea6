import re
from collections import Counter

from framewright.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def covered(text, n):
    """Characters inside n-grams seen before, over all in words."""
    words, seen, inside = WORD.findall(text or ""), set(), set()
    for k in range(len(words) - n + 1):
        gram = tuple(words[k : k + n])
        if gram in seen:
            inside |= set(range(k, k + n))
        seen.add(gram)
    total = sum(map(len, words))
    return sum(len(words[k]) for k in inside) / total if total else 0.0


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        assert (r["m_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text)
        assert abs(r["dup_gram_chars"] - max(covered(text, n) for n in (5, 6, 8, 10))) < 1e-9
        assert not (r["kept"] and r["base_failed"])


def test_small_table_against_brute_force(documents, plain):
    rows = Q.quality_rules(documents, keep=["doc_id"]).withColumnRenamed("n_words", "m_words").orderBy("doc_id").collect()
    check(rows, [plain[r["doc_id"]] for r in rows])


def test_edges(edges):
    out = Q.quality_rules(edges, keep=["doc_id", "text", "n_words", "kept"])
    assert {"_n_words", "_kept"} <= set(out.columns)  # the table has columns of these names
    rows = [r.asDict() for r in out.collect()]
    for r in rows:
        assert r["n_words"] == "clash"
        r["m_words"], r["kept"] = r["_n_words"], r["_kept"]
    check(rows, [r["text"] for r in rows])


def test_verdicts():
    import pyarrow as pa

    from framewright.llm._words import chunks

    clean = " ".join(f"w{k}" for k in range(100))
    texts = [clean, "buy now " * 50, "\n".join(["the same line of words again here"] * 9), " ".join(f"w{k}##" for k in range(60)), "short text"]
    kept = [m for _, _, w in chunks(pa.array(texts)) for m in Q.measure(w, Q.RepetitionRules())["kept"].tolist()]
    assert kept == [True, False, False, False, False]


def test_empty_table(nothing):
    assert Q.quality_rules(nothing).count() == 0
