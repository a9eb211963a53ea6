"""Conversation repair: signatures against all edits, and the query against a plain replay of its rules."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from framewright.llm import conversation_repair as C


def cheapest(rows):
    """(cost, audit) by trying all edits of (initial, fault) up to two insertions in a row."""
    best = None

    def go(i, roles, audit, cost, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, roles + r, audit + "I", cost + 2, inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, roles, audit + "D", cost + 3, 0)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(i + 1, roles + initial, audit + "K", cost + more, 0)
                for r in "ua":
                    go(i + 1, roles + r, audit + "R", cost + 2 + more, 0)

    go(0, "", "", 0, 0)
    return best


def letter(initial, fault):
    return chr(ord("A") + 4 * "suax".index(initial) + C.FAULTS.index(fault))


def test_solve_against_all_edits():
    kinds = [(i, f) for i in "suax" for f in ("", "truncated", "blank")]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert C.solve("".join(letter(*r) for r in rows))[:2] == cheapest(rows)[::-1], rows
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suuaax"), rng.choice(C.FAULTS)) for _ in range(rng.randint(3, 5))]
        assert C.solve("".join(letter(*r) for r in rows))[:2] == cheapest(rows)[::-1], rows


def test_solve_long_signatures():
    """No recursion by length: 50,000 rows, the same cost as in parts that need no edit across."""
    audit, cost, *_ = C.solve("EI" * 25_000)
    assert cost == 0 and audit == "K" * 50_000
    assert C.solve("")[:2] == ("", 0)


def plainly(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} of the damaged rows, for short conversations."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        turns = {r[0] for r in own} - {None}
        cost, audit = cheapest([(i if i in "sua" and i else "x", f) for i, f in zip(initials, faults)])
        fixed, roles, left = [], "", list(own)
        for edit in audit:
            to = "assistant" if roles.endswith("u") else "user"
            if edit == "I":
                fixed.append((to, ""))
            else:
                _, role, text = left.pop(0)
                if edit == "D":
                    continue
                fixed.append((role if edit == "K" else to, text))
            roles += fixed[-1][0][0]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def audited(df):
    return {r["conv"]: (*(r[m] for m in C.MEASURES), r["audit"], r["repaired_sha256"]) for r in C.conversation_audits(C.damage(df)).collect()}


SCHEMA = "conv_id long, turn long, role string, text string, audit string, letter string, conv string, times string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], SCHEMA).repartition(3)


def test_query_against_plain_replay(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    short = {c for c in {r[0] for r in rows} if sum(r[0] == c for r in rows) < 5}
    got = {r["conv_id"]: (*(r[m] for m in C.MEASURES), r["audit"], r["repaired_sha256"]) for r in C.query(spark, sf).collect()}
    assert {*got} == {r[0] for r in rows}
    want = plainly([r for r in rows if r[0] in short])
    assert {c: got[c] for c in short} == want


def test_edges(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 4)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3 * turn]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin"]), rng.choice(["Yes.", "No", "", None, " \t\n", "Why?  \n", "x ", "日本。", "Wait... what\x0b", "." * 5000])))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (500, None, None, None), (501, 0, "user", "Hi."), (501, 0, "user", "Hi."), (501, 0, "assistant", "Hi."), (502, -5, "user", "a!"), (502, 4, "assistant", "b!")]
    assert audited(table(spark, rows)) == plainly(rows)
    assert C.conversation_audits(C.damage(table(spark, []))).count() == 0


def test_all_rows_dropped(spark):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = audited(table(spark, [(conv, 0, "user", "Hi.")]))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows_and_long_conversation(spark):
    """Rows of the repair agree with the digest, over Arrow batches that cut a conversation of 9,000 rows."""
    rows = [(7, k, ("user", "assistant")[k % 2], f"Text {k}.") for k in range(9000)] + [(8, 0, "assistant", "b."), (8, 1, "assistant", "no end")]
    damaged = C.damage(table(spark, rows))
    found = C.audits(damaged)
    out = C.repaired(damaged, found).collect()
    digests = {r["conv"]: r["repaired_sha256"] for r in C.digests(damaged, found).collect()}
    for conv in (7, 8):
        own = sorted((r for r in out if r["conv"] == conv and r["position"] is not None), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == digests[conv]
        audit = next(r["audit"] for r in found.collect() if r["conv"] == conv)
        assert len(audit) == sum(r["conv"] == conv for r in out) and len(own) == len(audit) - audit.count("D")


@pytest.mark.parametrize("n", [1, 5])
def test_partitions_change_nothing(spark, sf, n):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert C.conversation_audits(C.damage(rows.repartition(n))).exceptAll(C.conversation_audits(C.damage(rows))).count() == 0
