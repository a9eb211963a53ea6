"""Conversation structure repair by signature deduplication.

A conversation becomes a compact string, its *signature*: a letter for each row that tells the role and the first fault. Conversations of one
shape share it, so each distinct signature is solved once, by memoised recursion, and its audit (the cheapest edits) is joined back. Replaying the
edits over the rows in order gives the repaired conversation.

Rows are sorted by Spark within partitions of conversations and streamed: a task holds a signature or an audit, a byte a row of one
conversation, and never its texts. A digest of a conversation depends on all of it in order, so its rows pass one task, one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import arrow_type, small_batches, stage

SPACE = " \t\n\x0b\f\r"
#: Kinds of roles by their initial, and first faults; a row's letter is A + 4 * kind + fault.
KINDS, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
DROPPED = -1
KEEP, REROLE, DELETE, INSERT, TRUNCATED, NEVER = 0, 2, 3, 2, 1, 1 << 40
#: What a repaired conversation has had: nothing; a system row alone; a user's row, unanswered; an answer.
START, SYSTEM, ASKED, ANSWERED = range(4)
ROLE = {START: "user", SYSTEM: "user", ASKED: "assistant", ANSWERED: "user"}
_THEN = {("s", START): SYSTEM, ("u", START): ASKED, ("u", SYSTEM): ASKED, ("u", ANSWERED): ASKED, ("a", ASKED): ANSWERED}
MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, times) of rows, with faults planted by crc32(conv:turn) modulo 20; nulls in it, in role and in text are a space.

    0 drops the row (times = 0), 1 empties its text, 2 takes its [.!?] away, 3 repeats it (times = 2), 4 sets the role user.
    """
    given = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    code = F.crc32(F.concat(given(conv), F.lit(":"), given(turn))) % 20
    own = rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), given(role).alias("role"), given(text).alias("text"), code.alias("code"))
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select("conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("times"))


def _order(*within: str) -> list[Column]:
    """Of a conversation's rows: by turn, then by role and text. Rows equal in all of these may change places."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), *map(F.col, within)]


def _copies(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, times), each as often as times says; times = 0 stays as one row."""
    return rows.select("conv", "turn", "role", "text", "times", F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1)))).alias("k"))


def faulty(rows: DataFrame) -> DataFrame:
    """(conv, turn, letter) for rows (conv, turn, role, text, times): each copy's kind and first fault, in order within conversations, each of
    which lies in one partition; times = 0 gives one row of letter DROPPED.

    The window needs no shuffle of its own: rows of a conversation lie together already.
    """
    alike = Window.partitionBy("conv", "role", "text", F.col("times") > 0).orderBy(F.col("turn").asc_nulls_first())
    seen = _copies(rows).repartition("conv").withColumn("copy", F.row_number().over(alike))
    body = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == KINDS[0], 0).when(initial == KINDS[1], 1).when(initial == KINDS[2], 2).otherwise(3)
    fault = F.when(body == "", 2).when(F.col("copy") > 1, 3).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    letter = F.when(F.col("times") == 0, DROPPED).otherwise(4 * kind + fault).alias("letter")
    return seen.sortWithinPartitions("conv", *_order("copy")).select("conv", "turn", letter)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices of rows of one conversation (the first column), and whether each begins one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0)
        code = conv.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
        for lo, hi in pairwise(cut):
            own = conv[lo].as_py()
            yield batch.slice(lo, hi - lo), lo > 0 or last is None or last[0] != own
            last = (own,)


def _signatures(kind: pa.DataType):
    """Arrow rows (conv, turn, letter), ordered -> (conv, gaps, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv = least = most = None
        distinct, parts = 0, []

        def row() -> tuple:
            return conv, 0 if least is None else int(most - least + 1 - distinct), b"".join(parts).decode()

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, pa.int64(), pa.string()))], ["conv", "gaps", "signature"])

        for rows, begins in _groups(batches):
            if begins:
                if parts:
                    done.append(row())
                    if len(done) == 2000:
                        yield given(done)
                        done = []
                conv, least, most, distinct, parts = rows.column(0)[0].as_py(), None, None, 0, []
            letters = rows.column(2).to_numpy(zero_copy_only=False)
            parts.append((letters[letters != DROPPED] + ord("A")).astype(np.uint8).tobytes())
            for turn, letter in zip(rows.column(1).to_pylist(), letters):  # in order, nulls first
                if letter != DROPPED and turn is not None and turn != most:
                    least, most, distinct = turn if least is None else least, turn, distinct + 1
        if parts:
            done.append(row())
        if done:
            yield given(done)

    return run


@lru_cache(1 << 16)
def _step(letter: int | None, after: tuple[int, ...] | None) -> tuple[tuple[int, ...], tuple[tuple[tuple[str, int], ...], ...]]:
    """Before a row of this letter (None: at the end), whose rest costs ``after`` by state: what it then costs by state, and the first edit
    and the state after it by state and insertions just made.

    The answer depends on nothing else, so one cache serves all rows of all signatures.
    """
    initial, fault = (None, None) if letter is None else ((KINDS + "x")[letter // 4], FAULTS[letter % 4])

    @cache
    def best(state: int, inserted: int) -> tuple[int, str, int]:
        found = []
        to = _THEN["a" if state == ASKED else "u", state]
        if letter is None and state in (START, ANSWERED):
            found.append((0, "", state))
        if inserted < 2:
            found.append((INSERT + best(to, inserted + 1)[0], "I", to))
        if letter is not None:
            found.append((DELETE + after[state], "D", state))
            if fault in ("", "truncated"):
                more = TRUNCATED * (fault == "truncated")
                if (kept := _THEN.get((initial, state))) is not None:
                    found.append((KEEP + more + after[kept], "K", kept))
                found.append((REROLE + more + after[to], "R", to))
        return min(found, default=(NEVER, "", state))

    every = [[best(state, inserted) for inserted in range(3)] for state in range(4)]
    return tuple(e[0][0] for e in every), tuple(tuple(x[1:] for x in e) for e in every)


def solve(signature: str) -> tuple[str, int, int, int, int, int]:
    """(audit, cost, blank, duplicate, truncated, illegal) of a signature.

    The audit is the least string of the cheapest edits: Delete, Insert, Keep or Rerole for each row, or for a row put in. Edits of one initial lead from a
    state to one other only, so the least initial among the cheapest is the least string. A third insertion in a row would come back to a
    state that was there before, at a cost, so two are enough. Costs of the rest are kept less the least of them, so few differ.
    """
    code = [ord(c) - ord("A") for c in signature]
    costs, edits = _step(None, None)
    base, steps = 0, [edits]
    for letter in reversed(code):
        low = min(costs)
        costs, edits = _step(letter, tuple(c - low for c in costs))
        base += low
        steps.append(edits)
    steps.reverse()
    audit, i, state, inserted = [], 0, START, 0
    while (edit := steps[i][state][inserted])[0]:
        audit.append(edit[0])
        state, (i, inserted) = edit[1], (i, inserted + 1) if edit[0] == "I" else (i + 1, 0)
    initials, fault = [(KINDS + "x")[c // 4] for c in code], [FAULTS[c % 4] for c in code]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
    return "".join(audit), base + costs[START], fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["audit", "cost", "blank", "duplicate", "truncated", "illegal"]
    for frame in frames:
        yield pd.concat([frame, pd.DataFrame([solve(s) for s in frame["signature"]], columns=names, index=frame.index)], axis=1)


def audits(rows: DataFrame) -> DataFrame:
    """(conv, audit, MEASURES) of the conversations of rows (conv, turn, role, text, times)."""
    small_batches(rows.sparkSession)
    kind = rows.schema["conv"].dataType.simpleString()
    signed = stage(faulty(rows).mapInArrow(_signatures(arrow_type(rows, "conv")), f"conv {kind}, gaps bigint, signature string"))
    solved = stage(signed.select("signature").distinct().mapInPandas(_solved, "signature string, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"))
    return stage(signed.join(solved, "signature").select("conv", "audit", *MEASURES))


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[tuple[str, str | None, str, str]]]]:
    """(slice, first row, edits) of ordered rows (conv, audit, turn, role, text, ...), where a conversation's audit comes first: for each slice the
    edits made by the time of its last row, as (initial, turn, role, text); the first row of a slice is its audit if it begins a conversation."""
    audit, at, state = "", 0, START
    for rows, begins in _groups(batches):
        edits = []

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                edits.append(("I", None, ROLE[state], ""))
                state, at = _THEN["a" if state == ASKED else "u", state], at + 1

        if begins:
            audit, at, state = rows.column(1)[0].as_py(), 0, START
            inserts()
        own = rows.slice(int(begins))
        for turn, role, text in zip(*(own.column(k).to_pylist() for k in (2, 3, 4))):
            edit, at = audit[at], at + 1
            if edit == "R":
                role = ROLE[state]
            if edit != "D":
                state = _THEN[role[0], state]
            edits.append((edit, turn, role, text))
            inserts()
        yield rows, int(begins), edits


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, audit, turn, role, text, MEASURES), ordered, the row of found first in each conversation."""
    kept = _copies(rows.filter("times > 0")).select("conv", "turn", "role", "text", F.lit(1).alias("message"))
    both = kept.unionByName(found.withColumn("message", F.lit(0)), allowMissingColumns=True).repartition("conv")
    return both.sortWithinPartitions("conv", "message", *_order()).select("conv", "audit", "turn", "role", "text", *MEASURES)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, position, edit, turn, role, text) for what the audits ``found`` make of rows: deleted rows have no position, inserted ones no turn and an empty text."""
    conv, turn = arrow_type(rows, "conv"), arrow_type(rows, "turn")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for part, begins, edits in _replayed(batches):
            place = 0 if begins else place
            stays = [e[0] != "D" for e in edits]
            positions = [place + k - 1 if s else None for k, s in zip(np.cumsum(stays).tolist(), stays)]
            place += sum(stays)
            columns = [pa.array([part.column(0)[0].as_py()] * len(edits), conv), pa.array(positions, pa.int64()), *(pa.array([e[k] for e in edits], t) for k, t in enumerate((pa.string(), turn, pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "position", "edit", "turn", "role", "text"])

    return _with_audits(rows, found).mapInArrow(run, f"conv {kinds['conv']}, position bigint, edit string, turn {kinds['turn']}, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, MEASURES, audit, repaired_sha256): the hash of each repaired conversation's ``role:text``, joined by line feeds."""
    names = ["conv", *MEASURES, "audit"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*names).schema) + ", repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = total = None
        empty, done = True, []

        def given() -> pa.RecordBatch:
            table = pa.concat_tables([pa.Table.from_batches([h.select(names)]) for h, _ in done]).combine_chunks()
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns), pa.array([d for _, d in done])], [*names, "repaired_sha256"])

        for part, begins, edits in _replayed(batches):
            if begins:
                if head is not None:
                    done.append((head, total.hexdigest()))
                    if len(done) == 2000:
                        yield given()
                        done = []
                head, total, empty = part.slice(0, 1), hashlib.sha256(), True
            for edit, _, role, text in edits:
                if edit != "D":
                    total.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
        if head is not None:
            done.append((head, total.hexdigest()))
            yield given()

    return _with_audits(rows, found).mapInArrow(run, schema)


def conversation_audits(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv, turn, role, text, times): conv, MEASURES, audit, repaired_sha256.

    A conversation's rows count by turn (nulls first), then by role and text; copies stand beside their row. times: how often a row comes; a conversation
    whose rows all have times = 0 gives zeros, an empty audit and the hash of nothing. A row's first fault counts: blank, duplicate (role and text
    came before), truncated (the last character that isn't white space is none of .!?). gaps: numbers without a turn between the least and greatest; turns
    are numbers, null ones aside. illegal: adjacent roles that aren't system-user, user-assistant or assistant-user, by initial. cost and audit:
    see solve(). Rows of a null conv are one conversation. role and text may not be null. An empty table gives no rows.
    """
    return digests(rows, audits(rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all conversations, damaged and repaired."""
    return conversation_audits(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")
