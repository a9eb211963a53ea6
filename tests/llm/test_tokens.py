"""Token-id output, packing and mixing against the tokenizers library and brute force."""

import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from framewright.llm import mixing as M
from framewright.llm import packing as P
from framewright.llm import token_output as T
from framewright.llm._spark import shared_dir

WORD = re.compile("[^\x20\x09-\x0d]+")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(path, texts, end):
    library = Tokenizer.from_file(path)
    return [np.array([*e.ids, end], "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def key(row):
    return row[0] is not None, row[0] or 0


def check_output(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    T.write_tokens(docs, path, BYTES, 50257)
    got = T.read_tokens(spark, path, ids=True).collect()
    want = Counter((i, x.tobytes()) for (i, _), x in zip(rows, ids_of(BYTES, [t for _, t in rows], 0)))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted((i for i in order if i is None), key=str) + sorted(i for i in order if i is not None)


def test_output_of_small_table(spark, documents):
    check_output(spark, documents)


def test_output_of_edges(spark, edges, nothing):
    check_output(spark, edges)
    check_output(spark, nothing)


def test_encoder_equals_library():
    """Texts of strings that tokens and their rules turn on, those of added tokens among them, in both readings of these."""
    import random

    import pyarrow as pa

    from framewright.llm._encode import Encoder

    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|startoftext|>", "hello", "it's", " ", "\n", "é", "日本", "123", "x<|endoftext|>y", "<|endoftext|", "\x00", "!?", "\t", " don't", "İ", "ß", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for path, glue in ((BYTES, True), (WORDS, False)):
        for literal in (False, True):
            library, own = Tokenizer.from_file(path), Encoder(path, glue, literal)
            library.encode_special_tokens = literal
            assert own.known
            got = [x.tolist() for k in range(0, len(texts), 500) for x in own.encode(pa.array(texts[k : k + 500]))]
            assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_files_go_to_the_library(tmp_path):
    import pyarrow as pa

    from framewright.llm._encode import Encoder

    other = Tokenizer.from_file(BYTES)
    from tokenizers import normalizers

    other.normalizer = normalizers.Lowercase()
    other.save(f"{tmp_path}/other.json")
    own = Encoder(f"{tmp_path}/other.json", True)
    assert not own.known
    assert own.encode(pa.array(["ABC def", None, ""]))[0].tolist() == other.encode("ABC def", add_special_tokens=False).ids


def test_output_keeps_id_types(spark):
    docs = spark.createDataFrame([(f"k{k}", "a b c") for k in range(5)], "doc_id string, text string")
    check_output(spark, docs)
    docs = docs.selectExpr("cast(substr(doc_id, 2) as smallint) AS doc_id", "text")
    check_output(spark, docs)


def test_coder_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 40_000, 100_000):
        ids = rng.zipf(1.3, n).clip(1, 999).astype(np.uint32)
        table = T.Table.of(np.bincount(ids, minlength=1000))
        data = T.encode_segment(ids, table)
        assert (T.decode_segment(data, table, table.symbols()) == ids).all()
        caught = 0
        for at in range(60, len(data), max(1, len(data) // 40)) if n > 1000 else ():
            broken = bytearray(data)
            broken[at] ^= 1
            try:  # what is read from a checkpoint's last words may not matter; else the checksum tells
                assert (T.decode_segment(bytes(broken), table, table.symbols()) == ids).all()
            except ValueError:
                caught += 1
        assert caught > 10 or n <= 1000


def check_packing(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = P.pack(docs, WORDS, ids=True).collect()
    want = Counter((i, len(x)) for (i, _), x in zip(rows, ids_of(WORDS, [t for _, t in rows], 2)))
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    per = defaultdict(list)
    for (i, _), x in zip(rows, ids_of(WORDS, [t for _, t in rows], 2)):
        for at in range(0, len(x), P.CONTEXT):
            per[i].append((at, x[at : at + P.CONTEXT].tobytes()))
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in got) == Counter((i, a, b) for i, parts in per.items() for a, b in parts)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= P.CONTEXT
    return len(by), sum(r["length"] for r in got)


def test_packing_of_small_table(documents):
    sequences, tokens = check_packing(documents)
    assert sequences <= -(-tokens // P.CONTEXT) * 1.03 + 2


def test_packing_of_edges(edges, nothing):
    check_packing(edges)
    assert P.pack(nothing, WORDS).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(2)
    sizes = np.arange(1, 101)
    counts = rng.integers(0, 50, 100)
    sizes, counts = sizes[counts > 0], counts[counts > 0]
    patterns = P.rounded(sizes, counts, 128)
    assert (sum(p * n for p, n in patterns) == counts).all()
    assert all((p * sizes).sum() <= 128 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= max(-(-(sizes * counts).sum() // 128), (counts * (sizes > 64)).sum()) * 1.05 + 3


def test_program_converges_on_dense_histograms():
    """200,000 rests over 512 classes, within half a percent of the bound."""
    import time

    rng = np.random.default_rng(0)
    for rests in (rng.integers(1, 513, 200_000), np.clip(np.ceil(np.exp(rng.normal(6.0, 1.2, 200_000)) % 4096 / 8), 1, 512).astype(np.int64)):
        sizes, counts = np.unique(rests, return_counts=True)
        began = time.process_time()
        patterns = P.rounded(sizes, counts, 512)
        assert time.process_time() - began < 20
        assert (sum(p * n for p, n in patterns) == counts).all() and all(p @ sizes <= 512 for p, _ in patterns)
        assert sum(n for _, n in patterns) <= 1.005 * -(-(sizes @ counts) // 512)


IN_SESSION = """
import sys, numpy as np
from framewright.session import local_session
from framewright.llm import packing as P
spark = local_session(2, 2, "1g")
spark.range(10).count()
steps, times = 0, P._times
def counted(a, b):
    global steps
    steps += a.ndim == 2
    return times(a, b)
P._times = counted
sizes = np.arange(1, 1025)
counts = (3000 * np.exp(-sizes / 300)).astype(np.int64) + np.random.default_rng(1).integers(1, 90, 1024)
program, gap = P.cutting_stock(sizes, counts, 1024, gap=1e-7)
held = sum(p * use for p, use in program)
assert P._inverse(np.eye(300)[::-1] + np.tri(300)).shape == (300, 300)
assert (held >= counts * (1 - 1e-6)).all() and gap < 1e-3, gap
print("steps", steps)
"""


def test_program_ends_in_a_process_with_a_session():
    """Over 1,000 steps of the simplex method beside a running JVM, under a time limit: threaded LAPACK would wait for ever."""
    import subprocess
    import sys
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", IN_SESSION], capture_output=True, text=True, timeout=150, cwd=Path(__file__).resolve().parents[2])
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split("steps")[1]) > 1000


def test_inverse():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 200):
        a = rng.integers(0, 4, (n, n)) + np.diag(rng.permutation(n) + 0.5)[rng.permutation(n)]
        assert np.abs(np.einsum("ij,jk->ik", a, P._inverse(a)) - np.eye(n)).max() < 1e-6


def test_program_beats_best_fit():
    """Sizes whose best patterns best fit misses: 2 x 4 + 3 x 3 fill 17 exactly."""
    sizes, counts = np.array([3, 4, 7]), np.array([300, 200, 90])
    patterns = P.rounded(sizes, counts, 17)
    assert (sum(p * n for p, n in patterns) == counts).all()
    assert sum(n for _, n in patterns) <= sum(n for _, n in P.best_fit(sizes, counts, 17))
    assert sum(n for _, n in patterns) <= -(-(sizes @ counts) // 17) + 2


def test_hypergeometric_draws():
    rng = np.random.default_rng(4)
    for good, bad, n in ((10, 20, 15), (1000, 30, 500), (3, 0, 2), (0, 5, 3)):
        own = np.array([M.hypergeometric(rng, good, bad, n) for _ in range(4000)])
        want = rng.hypergeometric(good, bad, n, 4000)
        assert abs(own.mean() - want.mean()) < 0.15 * want.std() + 1e-9 and own.max() <= min(good, n) and own.min() >= max(0, n - bad)
    big = [M.hypergeometric(rng, 3 * 10**10, 4 * 10**10, 35 * 10**9) for _ in range(3)]
    assert all(abs(x - 15 * 10**9) < 10**6 for x in big) and len(set(big)) == 3


def test_mixed_documents_of_alike_rows(spark):
    """Rows equal in id, source and text: one stands for all, the same whatever the partitions."""
    rows = [(1, "a b c d", "s", f"v{k}") for k in range(6)] + [(k, f"w{k} x y", "t", "z") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h string")
    got = [Counter(map(tuple, M.mixed_documents(docs.repartition(n)).collect())) for n in (1, 5)]
    assert got[0] == got[1] and {r[3] for r in got[0] if r[0] == 1} <= {"v0"}


def test_targets():
    got = {s.name: s.target for s in M.targets({"b": 100, "a": 1000, None: 10})}
    # a weighs 3, b 1, the null source 2; together 1665, the null source stops at 20
    assert got[None] == 20
    assert abs(sum(got.values()) - 1665) < 1e-6 and got["a"] <= 2000 and got["b"] <= 200


def test_mix_of_small_table(spark, sf, documents):
    rows = documents.select("doc_id", "text", "source").collect()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    by = Counter()
    for r in rows:
        by[r["source"]] += size[r["doc_id"]]
    target = {s.name: s.target for s in M.targets(dict(by))}
    got = M.query(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 256
    again = {r["doc_id"]: r["taken"] for r in M.query(spark, sf).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mix_shards_are_disjoint_and_edges_hold(edges, nothing):
    mixed = M.mix(edges, block_words=16, shard_words=500)
    blocks = mixed.blocks.collect()
    draws = Counter((r["doc_id"], r["text_hash"], r["copy"], r["block"], r["pass"]) for r in blocks)
    assert max(draws.values()) == 1
    slots = defaultdict(list)
    for r in blocks:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) > 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert mixed.documents.count() == edges.count()
    assert M.mixed_documents(edges).columns == edges.columns
    assert M.mix(nothing).blocks.count() == 0 and M.mixed_documents(nothing).count() == 0
