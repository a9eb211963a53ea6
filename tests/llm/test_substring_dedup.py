import re
from collections import defaultdict

from framewright.llm import substring_dedup as S

from .conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def sentences(text):
    out, open_ = [], None
    found = list(WORD.finditer(text))
    for k, m in enumerate(found):
        if open_ is None:
            open_ = (m.start(), [])
        open_[1].append(m.group())
        w = m.group()
        if w[-1] in ".!?" or (len(w) > 1 and w[-1] in "\"')]}" and w[-2] in ".!?") or k + 1 == len(found) or "\n" in text[m.end() : found[k + 1].start()]:
            out.append(open_)
            open_ = None
    return out


def brute(docs):
    """{key: text after}; docs: {key: text}, keys in order of precedence."""
    cut = {k: sentences(t or "") for k, t in docs.items()}
    seen = defaultdict(list)
    enough = lambda n, words: n >= 3 and words >= 20 or n >= 2 and words >= 40
    for key, parts in cut.items():
        size, runs = [len(p[1]) for p in parts], set()
        for a in range(len(parts)):
            b = next((b for b in range(a + 1, len(parts) + 1) if enough(b - a, sum(size[a:b]))), None)
            runs |= {(a, b)} if b else set()
        for b in range(1, len(parts) + 1):
            a = next((a for a in range(b - 1, -1, -1) if enough(b - a, sum(size[a:b]))), None)
            runs |= {(a, b)} if a is not None else set()
        for a, b in sorted(runs):
            seen[tuple(w for p in parts[a:b] for w in p[1])].append((key, a, b))
    gone = defaultdict(set)
    for places in seen.values():
        for key, a, b in places:
            if (key, a) != places[0][:2]:
                gone[key] |= set(range(a, b))
    out = {}
    for key, text in docs.items():
        at = [p[0] for p in cut[key]] + [len(text or "")]
        out[key] = None if text is None else text[: at[0]] + "".join(text[at[k] : at[k + 1]] for k in range(len(cut[key])) if k not in gone[key])
    return out


def test_small_table_against_brute_force(documents, plain):
    want = brute(dict(sorted(plain.items())))
    got = {r["doc_id"]: r["text"] for r in S.substring_dedup(documents).collect()}
    assert got == want
    assert any(got[k] != plain[k] for k in got)


def test_edges(edges):
    out = S.substring_dedup(edges)
    assert out.columns == [*edges.columns, "_n_sentences", "n_removed"]
    before = {(r["doc_id"], r["text"]) for r in edges.filter("doc_id < 40").collect()}
    got = {r["doc_id"]: r for r in out.filter("doc_id < 40").collect()}
    # rows with a null id come last and share nothing with these; 40 comes after all of them
    want = brute(dict(sorted(before)))
    assert {k: r["text"] for k, r in got.items()} == want
    assert got[6]["text"] == "" and got[5]["n_removed"] == 0 and got[0]["text"] is None
    assert out.count() == edges.count()
    assert all(r["n_removed"] == 0 for r in out.filter("doc_id IS NULL OR doc_id = 40").collect())  # equal rows are one document


def test_passage_of_two_long_sentences(spark):
    passage = " ".join(f"p{k}" for k in range(30)) + ". " + " ".join(f"q{k}" for k in range(25)) + "."
    docs = spark.createDataFrame([(k, f"{prose(80 + k, 3)}\n{passage}\n{prose(90 + k, 3)}") for k in range(4)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in S.substring_dedup(docs).collect()}
    assert [passage in got[k] for k in range(4)] == [True, False, False, False]
    assert got[2] == f"{prose(82, 3)}\n{prose(92, 3)}"


def test_empty(nothing):
    assert S.substring_dedup(nothing).count() == 0


def words(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_passages_that_do_not_keep_to_sentences(spark):
    """Mid-sentence, within one long sentence, without any end mark, and of a script without spaces; each in three documents."""
    passage, chars = words("p", 60), "".join(chr(0x4E00 + 7 * k) for k in range(60))
    forms = [lambda k: f"{words(f'a{k}x', 9)} {passage} {words(f'b{k}x', 9)}.", lambda k: f"{words(f'c{k}x', 30)}. {words('q', 60)} {words(f'd{k}x', 5)}.", lambda k: f"{words(f'e{k}x', 40)} {words('r', 60)}", lambda k: "".join(chr(0x6E00 + 97 * k + m) for m in range(30)) + chars + "".join(chr(0x7E00 + 97 * k + m) for m in range(30))]
    texts = {10 * f + k: form(k) for f, form in enumerate(forms) for k in range(3)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.substring_dedup(docs, passage=S.PASSAGE).collect()}
    for f, tag in enumerate(["p", "q", "r", None]):
        assert got[10 * f]["text"] == texts[10 * f] and got[10 * f]["n_removed"] == 0
        for k in (1, 2):
            key = 10 * f + k
            units = lambda t: list(t) if tag is None else WORD.findall(t)  # noqa: B023, E731
            passage_units = set(chars) if tag is None else {f"{tag}{m}" for m in range(60)}
            left = [u for u in units(got[key]["text"]) if u in passage_units]
            assert len(left) <= 14 and got[key]["n_removed"] > 0
            assert [u for u in units(got[key]["text"]) if u not in passage_units] == [u for u in units(texts[key]) if u not in passage_units]


def test_passage_repeated_in_its_own_text_stays_once(spark):
    docs = spark.createDataFrame([(0, "a b " * 100)], "doc_id long, text string")
    assert S.substring_dedup(docs, passage=S.PASSAGE).collect()[0]["text"] == "a b " * 20


def test_all_passages_of_47_words_are_found():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(0, 90, 3)
        offset = np.concatenate([[0], np.cumsum(sizes)])
        hashes = rng.integers(0, 1 << 63, max(1, offset[-1])).astype(np.uint64)
        got = set(S.winnowed(hashes, offset, 40, 8).tolist())
        for lo, hi in zip(offset[:-1], offset[1:]):
            for a in range(lo, hi - 46):
                assert a + int(np.argmin(hashes[a : a + 8])) in got


def test_query_finds_passages(spark, tmp_path):
    docs = [(k, f"{words(f'a{k}x', 9)} {words('p', 60)} {words(f'b{k}x', 9)}.") for k in range(2)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] for r in S.query(spark, str(tmp_path)).collect()} == {0: 0, 1: 1}


def test_runs_that_share_a_hash_by_chance_stay(spark, monkeypatch):
    """With a first hash of a few bits all runs meet; the second one keeps what isn't repeated."""
    import re
    from pathlib import Path

    from framewright.llm import substring_dedup as D

    rows = [(k, prose(k, 12)) for k in range(30)] + [(100, prose(3, 12) + " " + prose(500, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: (r["text"], r["n_removed"]) for r in D.substring_dedup(docs, passage=D.PASSAGE).collect()}
    source = Path(D.__file__).read_text()
    weak = {**vars(D)}
    exec(compile(re.sub(r"out = \[pa.array\(hashed\(a, b\).view\(np.int64\)\)\]", "out = [pa.array((hashed(a, b) & _U(3)).view(np.int64))]", source), D.__file__, "exec"), weak)
    assert "& _U(3)" not in source and {r["doc_id"]: (r["text"], r["n_removed"]) for r in weak["substring_dedup"](docs, passage=D.PASSAGE).collect()} == want
    assert sum(n for _, n in want.values()) >= 10
