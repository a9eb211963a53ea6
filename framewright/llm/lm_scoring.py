"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(class | before) * P(slot | class, before) * P(word | the class's rest). A word's class follows from its ending,
so unseen words have one too; a slot is one of a class's most frequent words or its rest, within which words share by counts.
Both softmaxes sum weights of hashed features: the word before, the one before that (a skip), and the two together (an n-gram).
Weights start from counts and are trained by distributed gradient updates: each round takes the gradient over another part of the
training documents (by a hash of id and text), Spark adds the tasks' tables up, and the driver makes the step. The tables have twice the
square root of the number of training tokens as rows for each feature; as a driver and every worker hold them whole, ``most_rows`` bounds them, and a
warning says so where it does. What grows without a bound (words and their counts) stays in Spark tables and is shuffled.

A word's key has 59 bits of its hash and 5 of its class, so counts and the number of distinct words are exact up to some 10^8 distinct words.

Documents are kept as *chunks*: their word keys, and each token as a place in them. A chunk's keys are joined to the corpus
counts by key and come back to their chunk, so no task needs the whole vocabulary.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow_type, gathered, small_batches, stage
from ._words import Words, chunks, mix64

CHUNK_TOKENS = 4_000_000
CLASSES, SLOTS = 32, 32
#: Rows for each feature: twice the square root of the number of training tokens, as a power of two from the least on. The most take 100 MB for each of the
#: class and the slot tables, and are reached with 10^10 tokens and more.
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 18
_LOG = logging.getLogger(__name__)
FEATURES = 3
END_CLASS = CLASSES - 1
ROUNDS = 3
#: A word with one in so many of the training tokens may have a slot: there are no more such words than this.
FREQUENT = 20_000
_U = np.uint64
_TAIL = np.zeros(256, np.int64)
_TAIL[[ord(c) for c in ",;:"]], _TAIL[[ord(c) for c in ".!?"]] = 1, 2
_CLASS_BITS = _U(CLASSES - 1)
END_KEY = _U(0xE4D0E4D0E4D0E4C0) | _U(END_CLASS)
_SEED = [mix64(np.array([k + 1], _U))[0] | _U(1) for k in range(5)]


def word_keys(words: Words) -> np.ndarray:
    """A word's key: its hash (A-Z in lower case), the last five bits replaced by its class, 0 to CLASSES - 2."""
    if not len(words.start):
        return np.zeros(0, _U)
    last = words.data[words.end - 1].astype(np.int64)
    tail = np.where(words.end - words.start > 1, _TAIL[last], 0)
    end = words.end - (tail > 0)
    a, b = words.data[end - 1].astype(np.int64) | 32, words.data[np.maximum(end - 2, words.start)].astype(np.int64) | 32
    kind = (mix64((a * 256 + b).astype(_U)) % _U((CLASSES - 1) // 3)).astype(np.int64)
    return (words.hashes(lower=True) & ~_CLASS_BITS) | (kind * 3 + tail).astype(_U)


@dataclass
class Model:
    """class_bias, slot_bias: log frequencies; w1: weights of (feature, class), w2: of (feature and class, slot), a table for each feature."""

    class_bias: np.ndarray
    slot_bias: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    slot_keys: np.ndarray
    slot_of: np.ndarray
    rest: np.ndarray  # for each class the log10 of what its rest's counts (each with 0.5 more, an unknown word too) add up to

    @property
    def rows(self) -> int:
        return len(self.w1) // FEATURES

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each word: 0 for the rest of its class."""
        at = np.minimum(np.searchsorted(self.slot_keys, keys), len(self.slot_keys) - 1)
        return np.where(self.slot_keys[at] == keys, self.slot_of[at], 0)


@dataclass
class Context:
    """What the tokens of a run stand in: their rows in the class tables (first) and in the slot tables (second), one of each feature's, and
    their classes; alike and alike_in: hashes of what the softmax over classes, and that over a class's slots, depend on."""

    first: np.ndarray
    second: np.ndarray
    cls: np.ndarray
    alike: np.ndarray
    alike_in: np.ndarray


def context(keys: np.ndarray, doc: np.ndarray, n_rows: int, back: int = 0) -> Context:
    """keys and doc of tokens in order; the first ``back`` of them only give those after them their features."""
    edge = _U(0x5EED)
    one, two = np.full(len(keys), edge), np.full(len(keys), edge)
    one[1:] = np.where(doc[1:] == doc[:-1], keys[:-1], edge)
    two[2:] = np.where(doc[2:] == doc[:-2], keys[:-2], edge)
    row = lambda x: (x >> _U(64 - n_rows.bit_length() + 1)).astype(np.int64)  # noqa: E731  the first bits
    one, two, cls = one[back:], two[back:], keys[back:] & _CLASS_BITS
    a, b = mix64(one ^ _SEED[0]), mix64(two ^ _SEED[1])
    c = mix64(a * _U(3) + b)
    inner = [mix64(x + cls * seed) for x, seed in zip((a, b, c), _SEED[2:])]
    return Context(np.stack([row(a), row(b), row(c)]), np.stack([row(x) for x in inner]), cls.astype(np.int64), c, inner[2])


def features(keys: np.ndarray, doc: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its rows in the class tables and in the slot tables, and its class."""
    own = context(keys, doc, n_rows)
    return own.first, own.second, own.cls


def alike_tokens(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of equal hashes together, so many hashes at a time: (one of each, how many there are, all of them, which hash each has)."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    bounds = np.append(start, len(order))
    for k in range(0, len(start), BATCH):
        own = bounds[k : k + BATCH + 1]
        size = np.diff(own)
        yield order[own[:-1]], size, order[own[0] : own[-1]], np.repeat(np.arange(len(size)), size)


def _summed_weights(table: np.ndarray, n_rows: int, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What the features' rows of a table and the bias add up to, less the greatest of each token, for which exp() is 1."""
    x = np.take(table, rows[0], 0)
    for t in range(1, FEATURES):
        x += np.take(table, t * n_rows + rows[t], 0)
    x += bias
    x -= x.max(1, keepdims=True)
    return x


def _logs(x: np.ndarray) -> np.ndarray:
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _shares(x: np.ndarray) -> np.ndarray:
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def class_weights(model: Model, rows: np.ndarray) -> np.ndarray:
    return _summed_weights(model.w1, model.rows, rows, model.class_bias)


def slot_weights(model: Model, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return _summed_weights(model.w2, model.rows, rows, model.slot_bias[cls])


def log_class(model: Model, rows: np.ndarray) -> np.ndarray:
    return _logs(class_weights(model, rows))


def log_slot(model: Model, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return _logs(slot_weights(model, rows, cls))


def _add(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of values to the row of a table. Rows that come once, most of them, are added as they are."""
    order = np.argsort(rows.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32), kind="stable")
    names = rows[order]
    at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    size = np.diff(np.append(at, len(names)))
    once = size == 1
    table[names[at[once]]] += np.take(values, order[at[once]], 0)
    if not once.all():
        several = ~once
        start = np.cumsum(size[several]) - size[several]
        table[names[at[several]]] += np.add.reduceat(np.take(values, order[np.repeat(several, size)], 0), start, axis=0)


def _add_ordered(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """_add() for rows that ascend."""
    at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    table[rows[at]] += values if len(at) == len(rows) else np.add.reduceat(values, at, axis=0)


def _count(table: np.ndarray, cells: np.ndarray) -> None:
    """Adds one to a table's cells, by their places in it: only those are touched, however large it is."""
    np.add.at(table.reshape(-1), cells.ravel(), np.float32(1))


def _chunks(kind: pa.DataType):
    """Arrow rows (id, held_out, turn, text) -> chunks (chunk, ids, held_out, turns, n_tokens, tokens, keys, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        part, number = TaskContext.get().partitionId(), 0
        ids, held, turns, sizes, parts = [], [], [], [], []

        def chunk() -> pa.RecordBatch:
            out = np.array([], bool) if not held else np.concatenate(held)
            size, keys = np.concatenate(sizes), np.concatenate(parts)
            known, place = np.unique(keys, return_inverse=True)
            counts = np.bincount(place[np.repeat(~out, size)], minlength=len(known)).astype("<u4")
            columns = [pa.array([part << 32 | number], pa.int64()), pa.array([sum((x.to_pylist() for x in ids), [])], pa.list_(kind)), pa.array([out.tolist()], pa.list_(pa.bool_())), pa.array([np.concatenate(turns).tolist()], pa.list_(pa.int8())), pa.array([size.tolist()], pa.list_(pa.int64()))]
            columns += [pa.array([x], pa.binary()) for x in (pack(place.astype("<u4").tobytes()), known.astype("<u8").tobytes(), counts.tobytes())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "held_out", "turns", "n_tokens", "tokens", "keys", "counts"])

        total = 0
        for batch in batches:
            for lo, hi, words in chunks(batch.column(3)):
                ids.append(batch.column(0).slice(lo, hi - lo))
                held.append(np.asarray(batch.column(1).slice(lo, hi - lo)))
                turns.append(np.asarray(batch.column(2).slice(lo, hi - lo)))
                sizes.append(words.count + 1)
                parts.append(np.insert(word_keys(words), words.offset[1:], END_KEY))
                total += len(parts[-1])
                if total >= CHUNK_TOKENS:
                    yield chunk()
                    ids, held, turns, sizes, parts, total, number = [], [], [], [], [], 0, number + 1
        if sizes:
            yield chunk()

    return run


def _key_rows(with_counts: bool):
    """Arrow rows (chunk, keys, counts) -> (chunk, key, n): what a chunk has of each word; (key, n) of words in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, counts in zip(*batch.columns):
                keys = np.frombuffer(keys.as_buffer(), "<i8")
                counts = np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
                if with_counts:
                    some = counts > 0
                    yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(counts[some])], ["key", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk.as_py())), pa.array(keys)], ["chunk", "key"])

    return run


def _tokens(sizes, tokens, keys) -> tuple[np.ndarray, np.ndarray]:
    """The key of each token of a chunk, and its document."""
    import zstandard

    place = np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens.as_buffer()), "<u4")
    size = np.asarray(sizes.values)
    return np.frombuffer(keys.as_buffer(), "<u8")[place], np.repeat(np.arange(len(size)), size)


#: Tokens whose contexts are made together, which share what they have in common; and contexts at a time, whose rows stay in a core's cache.
PIECE, BATCH = 1 << 18, 1 << 12


def _gradient(shared: Broadcast, n_rows: int, step: int | None):
    """Arrow rows (held_out, turns, n_tokens, tokens, keys) -> (row, v0, v1, ...): the rows that are not 0 of the tables of occurrences, first the
    class tables, then the slot tables; then, with step None, those of (class, slot), else, over a round's documents, of the expected ones."""
    tables = FEATURES * n_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen = [np.zeros((tables, CLASSES), np.float32), np.zeros((tables, SLOTS), np.float32)]
        expected = [np.zeros((tables, CLASSES), np.float32), np.zeros((tables, SLOTS), np.float32)] if step is not None else [np.zeros((CLASSES, SLOTS), np.float32)]
        for batch in batches:
            for held, turns, sizes, tokens, keys in zip(*batch.columns):
                keys, doc = _tokens(sizes, tokens, keys)
                train = ~np.asarray(held.values)
                if step is not None:
                    train &= np.asarray(turns.values) == step
                use = train[doc]
                keys, doc = keys[use], doc[use]
                for lo in range(0, len(keys), PIECE):
                    # two tokens more before the piece give its first ones their features
                    back = min(lo, 2)
                    k = keys[lo - back : lo + PIECE]
                    own = context(k, doc[lo - back : lo + PIECE], n_rows, back)
                    slot, place = model.slots(k[back:]), np.arange(FEATURES)[:, None] * n_rows
                    _count(seen[0], (place + own.first) * CLASSES + own.cls)
                    _count(seen[1], (place + own.second) * SLOTS + slot)
                    if step is None:
                        _count(expected[0], own.cls * SLOTS + slot)
                        continue
                    for table, rows, hashes in ((0, own.first, own.alike), (1, own.second, own.alike_in)):
                        for one, n, _, _ in alike_tokens(hashes):
                            part = rows[:, one]
                            p = _shares(slot_weights(model, part, own.cls[one]) if table else class_weights(model, part))
                            p *= n[:, None].astype(np.float32)
                            # the last feature's rows are the first bits of the hash by which tokens are in order
                            for t, add in enumerate((*[_add] * (FEATURES - 1), _add_ordered)):
                                add(expected[table][t * n_rows : (t + 1) * n_rows], part[t], p)
        at = 0
        for table in (*seen, *expected):
            some = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array((at + some).astype(np.int32)), *(pa.array(table[some, k]) for k in range(CLASSES))], ["row", *(f"v{k}" for k in range(CLASSES))])
            at += len(table)

    return run


def _summed(chunked: DataFrame, model: Model, step: int | None) -> np.ndarray:
    """The tables of all tasks, added up by Spark: 4 * FEATURES * most_rows rows at most, whatever the input."""
    columns = "row int, " + ", ".join(f"v{k} float" for k in range(CLASSES))
    tasks = gathered(chunked.select("held_out", "turns", "n_tokens", "tokens", "keys"))
    shared = chunked.sparkSession.sparkContext.broadcast(model)
    found = tasks.mapInArrow(_gradient(shared, model.rows, step), columns).groupBy("row").agg(*[F.sum(f"v{k}").cast("float").alias(f"v{k}") for k in range(CLASSES)]).toArrow()
    shared.destroy()
    tables = FEATURES * model.rows
    out = np.zeros((2 * tables + CLASSES if step is None else 4 * tables, CLASSES), np.float32)
    row = found["row"].to_numpy()
    for k in range(CLASSES):
        out[row, k] = found[f"v{k}"].to_numpy()
    return out


def rows_for(n: int, most_rows: int = MOST_ROWS) -> int:
    """Rows of each feature's tables for n training tokens: twice their square root, as a power of two."""
    wanted = max(LEAST_ROWS, 1 << round(math.log2(max(1.0, 2 * math.sqrt(n)))))
    if wanted > most_rows:
        _LOG.warning("language model: %d training tokens ask for %d rows a feature; most_rows leaves %d", n, wanted, most_rows)
    return min(most_rows, wanted)


def train(chunked: DataFrame, totals: DataFrame, most_rows: int = MOST_ROWS) -> tuple[Model, int, int]:
    """The model, and the numbers of training tokens and of distinct ones."""
    cls = F.col("key").bitwiseAND(CLASSES - 1)
    by_class = totals.groupBy(cls.alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = sum(r["n"] for r in by_class), sum(r["v"] for r in by_class)
    often = totals.filter(F.col("n") >= max(2, math.ceil(n / FREQUENT))).withColumn("class", cls).collect()  # FREQUENT rows at most
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        tokens[r["class"]], types[r["class"]] = r["n"], r["v"]
    slots: dict[int, int] = {}
    for c in range(CLASSES):
        top = sorted((r for r in often if r["class"] == c), key=lambda r: (-r["n"], r["key"]))[: SLOTS - 1]
        for k, r in enumerate(top):
            slots[r["key"] & 0xFFFFFFFFFFFFFFFF] = k + 1
            tokens[c] -= r["n"]
            types[c] -= 1
    keys = np.array(sorted(slots), _U)
    n_rows = rows_for(n, most_rows)
    tables = FEATURES * n_rows
    model = Model(np.zeros(CLASSES, np.float32), np.zeros((CLASSES, SLOTS), np.float32), np.zeros((tables, CLASSES), np.float32), np.zeros((tables, SLOTS), np.float32), keys if len(keys) else np.zeros(1, _U), np.array([slots[int(k)] for k in keys] or [0]), np.log10(tokens + 0.5 * (types + 1)))

    start = _summed(chunked, model, None)
    bias = start[2 * tables :].astype(float) + 0.5
    used = np.zeros((CLASSES, SLOTS), bool)  # slots that no word has stay impossible
    used[:, 0] = True
    for k, s in slots.items():
        used[k & (CLASSES - 1), s] = True
    model.class_bias = np.log(bias.sum(1) / bias.sum()).astype(np.float32)
    model.slot_bias = np.where(used, np.log(bias / np.where(used, bias, 0).sum(1, keepdims=True)), -60.0).astype(np.float32)
    # each feature says how its outcomes differ from all tokens'; together they share that
    prior = 20.0
    share = lambda x: x / x.sum(1, keepdims=True)
    for t in range(FEATURES):
        part = slice(t * n_rows, (t + 1) * n_rows)
        overall = share(start[part].sum(0, keepdims=True, dtype=float) + 0.5)
        model.w1[part] = np.log(share(start[part] + prior * overall) / overall) / FEATURES
    del start
    for step in range(ROUNDS):
        found = _summed(chunked, model, step)
        for table, at in ((model.w1, 0), (model.w2, tables)):
            seen, expected = found[at : at + tables], found[2 * tables + at : 3 * tables + at]
            # the gradient, each weight's divided by its expected count; at most one in the log for each step
            table += np.clip((seen - expected) / (expected + 5.0) / FEATURES, -1, 1)
    return model, n, v


def _score(shared: Broadcast, n: int, v: int):
    """A chunk's row and its (key, n) rows -> the rows of its documents."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        model, out = shared.value, []
        for row in left.itertuples(index=False):
            right = right.sort_values("key", key=lambda k: k.to_numpy().view(np.uint64))
            keys, known = right["key"].to_numpy().view(np.uint64), right["n"].to_numpy()
            import zstandard

            place = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.tokens), "<u4")
            size = np.asarray(row.n_tokens, np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            base = np.log10((known + 0.5) / (n + 0.5 * (v + 1)))
            cls_of = (keys & _CLASS_BITS).astype(np.int64)
            slot_of = model.slots(keys)
            rest = np.where(slot_of == 0, np.log10(known + 0.5) - model.rest[cls_of], 0.0)
            rest[cls_of == END_CLASS] = 0.0  # the end is all of its class
            total = np.zeros(len(size))
            for lo in range(0, len(place), PIECE):
                back = min(lo, 2)
                k, d, here = keys[place[lo - back : lo + PIECE]], doc[lo - back : lo + PIECE], place[lo : lo + PIECE]
                own, slot = context(k, d, model.rows, back), slot_of[here]
                log, inner = np.empty(len(here)), np.empty(len(here))
                for one, _, at, of in alike_tokens(own.alike):
                    log[at] = log_class(model, own.first[:, one])[of, own.cls[at]]
                for one, _, at, of in alike_tokens(own.alike_in):
                    inner[at] = log_slot(model, own.second[:, one], own.cls[one])[of, slot[at]]
                log += np.where(own.cls == END_CLASS, 0.0, inner)
                total += np.bincount(d[back:], log / math.log(10) + rest[here], minlength=len(size))
            sums = lambda x: np.bincount(doc, x[place], minlength=len(size))
            out.append(pd.DataFrame({"id": row.ids, "held_out": row.held_out, "n_tokens": size, "n_known": sums((known > 0).astype(float)).astype(np.int64), "train_tokens": n, "base_score": sums(base), "score": total}))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def prepared(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The staged chunks of docs, and (key, n): how often each word comes in training documents."""
    small_batches(docs.sparkSession)
    held = F.pmod(F.crc32(F.coalesce(docs[id].cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    source = docs.select(docs[id].alias("id"), held.alias("held_out"), F.pmod(F.xxhash64(docs[id], docs[text]), F.lit(ROUNDS)).cast("tinyint").alias("turn"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    columns = f"chunk bigint, ids array<{kind}>, held_out array<boolean>, turns array<tinyint>, n_tokens array<bigint>, tokens binary, keys binary, counts binary"
    chunked = stage(source.mapInArrow(_chunks(arrow_type(source, "id")), columns), compression="uncompressed")
    counted = chunked.select("chunk", "keys", "counts").mapInArrow(_key_rows(True), "key bigint, n bigint")
    return chunked, stage(counted.groupBy("key").agg(F.sum("n").alias("n")))


def lm_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """A row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    A document is held out of training if crc32(id as text) modulo 5 is 1 (a null id counts as the empty text). A null text is
    empty: its only token is the end. Repeated rows count and are scored one by one. Other columns are ignored. An empty table
    gives no rows; if nothing is left to train on, N and V are 0 and the weights stay 0. most_rows: a power of two that bounds the rows of a feature's tables.
    """
    chunked, totals = prepared(docs, id, text)
    kind, vocabulary = docs.schema[id].dataType.simpleString(), chunked.select("chunk", "keys", "counts")
    model, n, v = train(chunked, totals, most_rows)
    known = vocabulary.mapInArrow(_key_rows(False), "chunk bigint, key bigint").join(totals, "key", "left").select("chunk", "key", F.coalesce("n", F.lit(0)).alias("n"))
    rows = chunked.select("chunk", "ids", "held_out", "n_tokens", "tokens")
    parts = max(1, chunked.select("chunk").count())  # a task for each chunk, about
    by_chunk = lambda df: df.repartition(parts, "chunk").groupBy("chunk")
    scored = by_chunk(rows).cogroup(by_chunk(known)).applyInPandas(
        _score(docs.sparkSession.sparkContext.broadcast(model), n, v), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the scores of every document."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
