"""Packing by cutting-stock column generation.

Documents become token ids once; each is cut into full sequences and a rest. The rests, rounded up to units of a few tokens,
form a length histogram of bounded size. A linear program over patterns of the histogram's classes, whose columns come from
a knapsack dynamic program on the current prices, gives how often each pattern is used; what rounding down leaves over goes
by best fit. Pieces, ranked within their class, take the slots of the rounded patterns.

The program sees the histogram alone, at most CONTEXT / UNIT classes whatever the input; the ranks come from cells of about the
square root of the number of pieces, and a sequence's pieces (CONTEXT at most) meet only to add up their offsets.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._encode import encoder, forget
from ._spark import cells, passed, positions, small_batches, stage, tidy

CONTEXT, UNIT, END = 4096, 8, 2
#: The program ends when it is proven to be within this share of the optimum.
GAP = 5e-4
SETTLED = 500
_LOG = logging.getLogger(__name__)


def _knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``room`` the worth of the most valuable pattern, each size as often as it fits, and the size it ends with (-1: a gap)."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        n = np.searchsorted(sizes, w, "right")
        if n:
            worth = best[w - sizes[:n]] + prices[:n]
            k = int(worth.argmax())
            if worth[k] > best[w] + 1e-12:
                best[w], choice[w] = worth[k], k
    return best, choice


def _priced(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The worth of the best pattern, and the patterns worth more than a sequence that are best among those with some one size: a column each."""
    best, choice = _knapsack(sizes, prices, room)
    found = []
    for k in np.flatnonzero(best[room - sizes] + prices > 1 + 1e-5):
        pattern, w = np.zeros(len(sizes)), room - int(sizes[k])
        pattern[k] = 1
        while w > 0:
            if choice[w] < 0:
                w -= 1
            else:
                pattern[choice[w]] += 1
                w -= int(sizes[choice[w]])
        found.append(pattern)
    return float(best[room]), np.unique(found, axis=0).T if found else np.zeros((len(sizes), 0))


def best_fit(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, by best fit from the largest size down; sequences that hold the same go as one."""
    open_: list[list[tuple[tuple, int]]] = [[] for _ in range(room + 1)]  # by the room that is left
    for k in np.argsort(-sizes):
        size, need = int(sizes[k]), int(counts[k])
        while need:
            left = next((r for r in range(size, room) if open_[r]), None)
            if left is None:
                per = min(room // size, need)
                items, times, left = (), need // per, room
            else:
                items, times = open_[left].pop()
                per = max(1, min(left // size, need // times))
            used = min(times, need // per)
            if used < times:
                open_[left].append((items, times - used))
            open_[left - per * size].append(((*items, (k, per)), used))
            need -= used * per
    out = []
    for items, times in (x for group in open_ for x in group):
        pattern = np.zeros(len(sizes), np.int64)
        for k, per in items:
            pattern[k] += per
        out.append((pattern, times))
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b. Like _inverse() without BLAS or LAPACK: their threads can wait for ever in a process that has started Spark's JVM."""
    return np.einsum("i,ij->j" if a.ndim == 1 else "ij,j->i", a, b)


def _inverse(a: np.ndarray) -> np.ndarray:
    """The inverse, by Gauss-Jordan steps with row pivots in place."""
    a, n = a.copy(), len(a)
    rows = np.arange(n)
    for k in range(n):
        r = k + int(np.abs(a[k:, k]).argmax())
        if r != k:
            a[[k, r]], rows[[k, r]] = a[[r, k]], rows[[r, k]]
        pivot, a[k, k] = a[k, k], 1.0
        a[k] /= pivot
        factor = a[:, k].copy()
        factor[k], a[:k, k], a[k + 1 :, k] = 0, 0, 0
        some = np.flatnonzero(factor)
        a[some] -= factor[some, None] * a[k]
    out = np.empty_like(a)
    out[:, rows] = a
    return out


def cutting_stock(sizes: np.ndarray, counts: np.ndarray, room: int, gap: float = GAP, start: list[tuple[np.ndarray, int]] | None = None) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Patterns and how often each is used (a fraction) so that every count is met with about the fewest sequences; and the gap.

    The gap is by what share the uses may exceed the optimum: their sum over the best lower bound known, less one. ``start``: best fit's patterns, if known.

    The simplex method over a pool of columns, which starts from the patterns of best fit; when no column of the pool is worth more
    than a sequence, the knapsack prices new ones. It ends when the uses add up to at most 1 + gap times a lower bound (and one sequence), that of the prices
    (their worth over the best pattern's) or that of the rests' total size, or when no pattern is worth more than a sequence. Counts are
    raised by a trace of noise, which keeps degenerate steps from going round in circles, and the basis is inverted anew when its error shows. Should rounding
    errors still make it go on without a gain, for as many steps as there are sizes and SETTLED more, what is there stands, with a larger gap.
    """
    n = len(sizes)
    need = counts * (1 + 1e-5 * np.random.default_rng(3).random(n))
    least = float((sizes * counts).sum()) / room
    pool = np.array([p for p, _ in start or best_fit(sizes, counts, room)], float).T
    columns, cost = np.diag(room // sizes).astype(float), np.ones(n)
    use, inverse, steps = need / np.diag(columns), np.diag(1.0 / np.diag(columns)), 0
    fewest, since = np.inf, 0
    while since <= n + SETTLED:
        prices = _times(cost, inverse)
        if prices.min() < -1e-9:  # more of this class than there is need for
            column, price = -np.eye(n)[int(prices.argmin())], 0.0
        else:
            worth = _times(prices, pool)
            k = int(worth.argmax())
            if worth[k] <= 1 + 1e-6:
                value, fresh = _priced(sizes, prices, room)
                least = max(least, float((prices * need).sum()) / value)
                if (cost * use).sum() <= (1 + gap) * least + 1 or not fresh.shape[1]:
                    break
                pool = np.concatenate([pool, fresh], 1)
                continue
            column, price = pool[:, k], 1.0
        step = _times(inverse, column)
        up = step > 1e-9
        if not up.any():  # only rounding errors are left
            break
        ratio = np.full(n, np.inf)
        ratio[up] = use[up] / step[up]
        out = int(ratio.argmin())
        use -= ratio[out] * step
        use[out] = ratio[out]
        np.maximum(use, 0, out=use)
        columns[:, out], cost[out] = column, price
        inverse[out] /= step[out]
        step[out] = 0
        some = np.flatnonzero(step)
        inverse[some] -= step[some, None] * inverse[out]
        steps, since = steps + 1, since + 1
        if (cost * use).sum() < fewest * (1 - 1e-6):
            fewest, since = (cost * use).sum(), 0
        if steps % 100 == 0 and (np.abs(_times(columns, use) - need).max() > 1e-7 * need.max() or np.abs(_times(_times(cost, inverse), columns) - cost).max() > 1e-7):
            inverse = _inverse(columns)
            use = np.maximum(_times(inverse, need), 0)
    return [(columns[:, k].astype(np.int64), use[k]) for k in np.flatnonzero(cost)], float((cost * use).sum() / least - 1)


def rounded(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole uses of patterns that hold every piece exactly once: the program's, rounded down, with best fit for what is left over.

    Never more sequences than best fit takes for all pieces: if rounding costs more than the program saves, that one is returned.
    """
    if not len(sizes):
        return []
    plain = best_fit(sizes, counts, room)
    program, gap = cutting_stock(sizes, counts, room, start=plain)
    if (gap_in_sequences := gap * sum(use for _, use in program)) > 1 and gap > 2 * GAP:
        _LOG.warning("packing: the program ended %.2f %% (%.0f sequences) from its proven bound", 100 * gap, gap_in_sequences)
    left, out = counts.astype(np.int64).copy(), []
    for pattern, use in sorted(program, key=lambda x: -x[1]):
        some = pattern > 0
        times = min([math.floor(use + 1e-4), *(left[some] // pattern[some])]) if some.any() else 0
        if times:
            out.append((pattern, int(times)))
            left -= times * pattern
    rest = left > 0
    for pattern, times in best_fit(sizes[rest], left[rest], room):
        whole = np.zeros(len(sizes), np.int64)
        whole[rest] = pattern
        out.append((whole, times))
    return min(out, plain, key=lambda patterns: sum(times for _, times in patterns))


class Slots:
    """Where the pieces of each class go: ranges of ranks, the first sequence of each, how many lie in one sequence, and after how many others."""

    def __init__(self, sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]], first_sequence: int):
        taken, rows, sequence = np.zeros(len(sizes), np.int64), [[] for _ in sizes], first_sequence
        for pattern, times in patterns:
            slot = 0
            for k in np.flatnonzero(pattern):
                rows[k].append((taken[k], sequence, pattern[k], slot))
                taken[k] += times * pattern[k]
                slot += pattern[k]
            sequence += times
        self.at = {int(s): np.array(r, np.int64).T for s, r in zip(sizes, rows)}
        self.end = sequence

    def place(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, sequence, per, slot = self.at[size]
        k = np.searchsorted(begin, rank, "right") - 1
        past = rank - begin[k]
        return sequence[k] + past // per[k], slot[k] + past % per[k]


def _pieces(path: str, end: int, context: int, with_ids: bool):
    """Arrow rows (id, text_hash, text) -> a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path, glue=False).encode, np.array([end], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for k, own_ids in enumerate(encode(some.column(2))):
                    packed = own_ids.tobytes() + last
                    n = len(packed) // 4
                    for at in range(0, n, context):
                        piece = packed[4 * at : 4 * (at + context)]
                        row.append(k)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(piece)
                own = [passed(c.take(pa.array(row, pa.int64()))) for c in some.columns[:2]]
                made = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([*own, *made, *([pa.array(ids, pa.binary())] if with_ids else [])], ["id", "text_hash", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])
        forget()  # other stages follow in this worker

    return run


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", context: int = CONTEXT, unit: int = UNIT, end: int = END, ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for, as packed integers).

    A null text is empty: its only token is ``end``. Repeated rows are packed one by one. Null ids are values like any other; other
    columns of docs are ignored. An empty table gives no rows. Sequence ids are 0, 1, and so on without gaps.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id].alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_hash bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * ids
    pieces = stage(source.mapInArrow(tidy(_pieces(tokenizer, end, context, ids)), schema)).withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    sizes = np.array(sorted(histogram), np.int64)
    slots = Slots(sizes, rounded(sizes, np.array([histogram[int(s)] for s in sizes], np.int64), context // unit), 0)

    n = sum(histogram.values())
    spread = F.xxhash64("id", "text_hash", "start")
    keys = pieces.select("id", "text_hash", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids, "size")
    ranked = positions(keys, [F.col("size")], [spread, F.col("id"), F.col("text_hash"), F.col("start")], spread, cells(n, max(1, math.isqrt(n)))).drop("weight_before", "text_hash")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, slot = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            size, rank = frame["size"].to_numpy(), frame["position"].to_numpy()
            for s in np.unique(size):
                own = size == s
                sequence[own], slot[own] = slots.place(int(s), rank[own])
            yield frame.assign(sequence_id=sequence, slot=slot).drop(columns=["size", "position"])

    fields = [f.simpleString().replace(":", " ", 1) for f in ranked.drop("size", "position").schema]
    placed = ranked.mapInPandas(place, ", ".join([*fields, "sequence_id bigint", "slot bigint"]))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    return out.select(F.col("id").alias(id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of pack(ids=True): sequence_id, n_tokens, ids as packed little-endian integers without padding."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(parts, "")).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: where each piece of every document lies."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
