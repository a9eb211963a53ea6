"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; a run that occurs more than once in the corpus is kept where it
occurs first, and the sentences that its other occurrences cover are removed. A *run* is the shortest one from (and up to)
each sentence that has ``sentences`` of them and ``words`` words, or two sentences and ``many_words`` words, so that a repeated
passage of that size is covered from its first to its last whole sentence, while short phrases may recur.

Passages that don't keep to sentences are found by their words: of all runs of ``passage`` words, those are hashed too whose hash is
the least of ``window`` successive ones (winnowing). Every passage of passage + window - 1 words, wherever it starts and ends, has such
a run in common with its other occurrences, and as window <= passage the runs leave no gap: less than ``window`` words stay at
either end. A character of a script without spaces is a word here.

Three shuffles: hashes alone find those that occur twice (with map-side counts, so a frequent run is one row a task), a join
brings back the few occurrences of these, which a second hash of 32 bits tells apart, and the spans to remove meet their documents. The joins are plain equi-joins of
tables that stand by themselves, whose hot keys Spark splits at run time.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import free_name, passed, small_batches, stage, tidy
from ._words import CHUNK_BYTES, Words, chunks, mix64

#: Repeats of over 50 words are to be found, wherever they start; runs of 40 among windows of 8 find those of 47.
PASSAGE = 40
_U = np.uint64
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]}"]] = True
_WORD_BASE, _SECOND = 0x2545F4914F6CDD1D, _U(0x9FB21C651E98DF25)
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_WORD_BASE, pow(_WORD_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES // 2), base, _U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=_U)
    return _POWERS[0], _POWERS[1]


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each sentence (and the number of words at the end), and for each document its first sentence.

    A sentence ends at a word that ends in . ! or ? (closing quotes and brackets may follow), at a line's end, and at the text's.
    """
    n = len(words.start)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(words.offset), np.int64)
    last = words.data[words.end - 1]
    before = words.data[np.maximum(words.end - 2, words.start)]
    stop = _STOP[last] | (_CLOSE[last] & _STOP[before])
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])
    stop[:-1] |= lines[words.start[1:]] > lines[words.end[:-1]]
    ends = words.offset[1:]
    stop[ends[ends > 0] - 1] = True
    first = np.concatenate([[0], np.flatnonzero(stop) + 1])
    return first, np.searchsorted(first, words.offset)


def runs(first: np.ndarray, bounds: np.ndarray, n: int, words: int, many_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of every run of sentences i to j - 1; first and bounds as sentences() gives them."""
    s = np.arange(len(first) - 1)
    end = np.repeat(bounds[1:], np.diff(bounds))
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    j = np.minimum(np.maximum(s + n, np.searchsorted(first, first[s] + words)), np.maximum(s + 2, np.searchsorted(first, first[s] + many_words)))
    e = s + 1
    i = np.maximum(np.minimum(e - n, np.searchsorted(first, first[e] - words, "right") - 1), np.minimum(e - 2, np.searchsorted(first, first[e] - many_words, "right") - 1))
    ahead, back = j <= end, i >= begin
    both = np.unique(np.concatenate([s[ahead] << 32 | j[ahead], i[back] << 32 | e[back]]))
    return both >> 32, both & 0xFFFFFFFF


def unspaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, offset as of words, with a cut before and after each character of a script without spaces: Thai, Lao, Burmese, Khmer, U+3000 and above."""
    data = words.data
    wide = data >= 0xE3
    after = np.zeros_like(data)
    after[:-1] = data[1:]
    wide |= (data == 0xE0) & (after >= 0xB8) | (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))
    at = np.flatnonzero(wide)
    if not len(at):
        return words.start, words.end, words.offset
    beyond = at + np.where(data[at] >= 0xF0, 4, 3)
    ends = words.end[np.searchsorted(words.start, at, "right") - 1]
    start = np.union1d(words.start, np.concatenate([at, beyond[beyond < ends]]))
    end = np.minimum(np.append(start[1:], len(data)), words.end[np.searchsorted(words.start, start, "right") - 1])
    return start, end, np.searchsorted(start, words.bounds)


def _least(x: np.ndarray, window: int, of=np.minimum) -> np.ndarray:
    """For each place the least of so many values from it on; there are fewer at the end."""
    out, have = x.copy(), 1
    while have < window:
        step = min(have, window - have)
        if step < len(out):
            out[:-step] = of(out[:-step], out[step:].copy())
        have += step
    return out


def winnowed(hashes: np.ndarray, offset: np.ndarray, passage: int, window: int) -> np.ndarray:
    """The first words of the runs of passage words that have the least hash of window successive ones. hashes: of runs from each word on."""
    count = np.maximum(np.diff(offset) - passage + 1, 0)
    before = np.cumsum(count) - count
    start = np.arange(count.sum()) + np.repeat(offset[:-1] - before, count)
    # window - 1 values that are never the least keep documents apart
    place = np.arange(len(start)) + np.repeat(np.arange(len(count)) * (window - 1), count)
    own = np.full(len(start) + len(count) * (window - 1), ~_U(0))
    own[place] = hashes[start]
    least = _least(own, window)
    # a run is chosen if the greatest of the minima of the windows that it is in is its own
    chosen = _least(np.concatenate([np.zeros(window - 1, _U), least]), window, np.maximum)[: len(own)] == own
    return start[chosen[place]]


def _spans(n: int, words: int, many_words: int, passage: int, window: int, with_rows: bool):
    """Arrow rows (id, text_hash, text) -> one row a run: its hash, and with_rows the id, text_hash, its first word i, and again_j: 32 bits of
    a second hash before the 32 of j, the word after its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, chunk in chunks(batch.column(batch.num_columns - 1)):
                first, bounds = sentences(chunk)
                i, j = runs(first, bounds, n, words, many_words)
                start, end, offset = unspaced(chunk)
                place = np.append(np.searchsorted(start, chunk.start), len(start))
                a, b = place[first[i]], place[first[j]]
                up, down = _word_powers(len(start) + 1)
                own = chunk.spans_hash(start, end)
                prefix = np.concatenate([np.zeros(1, _U), np.cumsum(own * up[: len(start)])])
                hashed = lambda a, b: mix64((prefix[b] - prefix[a]) * down[a] + (b - a).astype(_U))  # noqa: B023, E731
                if passage and len(start) >= passage:
                    every = np.arange(len(start) - passage + 1)
                    c = winnowed(hashed(every, every + passage), offset, passage, window)
                    both = np.unique(np.concatenate([a << 32 | b, c << 32 | c + passage]))
                    a, b = both >> 32, both & 0xFFFFFFFF
                out = [pa.array(hashed(a, b).view(np.int64))]
                if with_rows:
                    doc = np.searchsorted(offset, a, "right") - 1
                    # the same sums over other numbers of the words
                    prefix = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(own ^ _SECOND) * up[: len(start)])])
                    again = hashed(a, b) & ~_U(0xFFFFFFFF)
                    out += [passed(c.take(pa.array(lo + doc))) for c in batch.columns[:2]]
                    out += [pa.array((a - offset[doc]).astype(np.int32)), pa.array((again | (b - offset[doc]).astype(_U)).view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, ["run", "id", "text_hash", "i", "again_j"][: len(out)])

    return run


def _removal():
    """Arrow rows (text, covered, ...) -> (text, n_sentences, n_removed, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, covered = batch.column(0), batch.column(1)
            counts, removed, new = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), {}
            for lo, _, chunk in chunks(texts):
                first, bounds = sentences(chunk)
                counts[lo : lo + len(bounds) - 1] = np.diff(bounds)
                touched = np.flatnonzero(np.asarray(covered.slice(lo, len(bounds) - 1).is_valid()))
                if not len(touched):
                    continue
                start, _, offset = unspaced(chunk)
                opens = np.searchsorted(start, chunk.start[first[:-1]])
                for d in touched:
                    size = offset[d + 1] - offset[d]
                    edges = np.zeros(size + 1, np.int64)
                    spans = covered[lo + d].values
                    np.add.at(edges, np.asarray(spans.field("i")), 1)
                    np.add.at(edges, np.asarray(spans.field("j")), -1)
                    gone = np.cumsum(edges)[:size] > 0
                    at = np.append(start[offset[d] : offset[d + 1]], chunk.bounds[d + 1])
                    # successive words of one kind are one piece
                    turn = np.concatenate([[0], np.flatnonzero(gone[1:] != gone[:-1]) + 1, [size]])
                    parts = [chunk.data[chunk.bounds[d] : at[0]].tobytes(), *(chunk.data[at[p] : at[q]].tobytes() for p, q in zip(turn[:-1], turn[1:]) if not gone[p])]
                    removed[lo + d] = np.add.reduceat(gone, opens[bounds[d] : bounds[d + 1]] - offset[d], dtype=np.int64).astype(bool).sum()
                    new[lo + d] = b"".join(parts).decode("utf-8", "replace")
            if new:
                values = texts.to_pylist()
                for k, text in new.items():
                    values[k] = text
                texts = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([passed(texts.cast(pa.string())), pa.array(counts), pa.array(removed), *map(passed, batch.columns[2:])], ["text", "n", "r", *batch.schema.names[2:]])

    return run


def _staged(df: DataFrame) -> DataFrame:
    """df staged; the shuffle files that it was made from go at once, where Spark would keep them until the driver happens to collect garbage."""
    out = stage(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 3, words: int = 20, many_words: int = 40, passage: int = 0, window: int = 8) -> DataFrame:
    """docs with repeated sentences removed from the text, and n_sentences, n_removed (before, and how many went in whole or in part).

    With ``passage``, runs of so many words count too, wherever they start and end, and what a repeat shares with the first occurrence
    in the same text stays; with 0 whole sentences only.

    The first occurrence of a run is that of the least id (null last), then of the least text hash, then of the least position.
    Rows with equal id and text are one document here and get the same result. Texts are cut between sentences (or words) only; what white
    space followed a removed one goes with it. A null text stays null; an empty one, or one of fewer sentences, stays as it is.
    If docs has columns n_sentences or n_removed, the new ones get underscores before their names.
    """
    if passage and not 0 < window <= passage:
        raise ValueError("a window is from 1 to passage words")
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    ours = [free_name(docs, "n_sentences"), free_name(docs, "n_removed")]
    kind = docs.schema[id].dataType.simpleString()
    source = docs.select(docs[id].alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    hashes = docs.select(docs[text].alias("text")).mapInArrow(tidy(_spans(n, words, many_words, passage, window, False)), "run bigint")
    repeated = _staged(hashes.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run"))
    rows = source.mapInArrow(tidy(_spans(n, words, many_words, passage, window, True)), f"run bigint, id {kind}, text_hash bigint, i int, again_j bigint")
    apart = {"again": F.shiftright("again_j", 32).cast("int"), "j": F.col("again_j").bitwiseAND(0xFFFFFFFF).cast("int")}
    found = _staged(rows.join(repeated, "run").withColumns(apart).drop("again_j"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "i")
    # runs that share a hash by chance differ in the second one, and none of them is a repeat
    first = _staged(found.groupBy("run", "again").agg(F.min(place).alias("first")))
    spans = found.withColumn("place", place).join(first, ["run", "again"]).filter("place != first")
    if passage:
        same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
        spans = spans.withColumn("i", F.when(same, F.greatest("i", F.col("first.i") + F.col("j") - F.col("i"))).otherwise(F.col("i")))
    spans = spans.select("id", "text_hash", F.struct("i", "j").alias("span"))
    # a document's spans, set by set: twice as many as it has sentences at most, and as it has words
    covered = _staged(spans.groupBy("id", "text_hash").agg(F.collect_set("span").alias("covered")).toDF("w", "h", "covered"))
    key = free_name(docs, "text_hash")
    whole = docs.withColumn(key, F.xxhash64(docs[text]))
    joined = whole.join(covered, (whole[key] == covered["h"]) & whole[id].eqNullSafe(covered["w"]), "left")
    # names by place, as those of docs may be any
    rest_names = [f"c{k}" for k in range(len(rest))]
    joined = joined.select(whole[text].alias("text"), covered["covered"].alias("covered"), *[whole[c].alias(n) for c, n in zip(rest, rest_names)])
    types = [f.dataType for f in docs.select(*rest).schema.fields]
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("r", T.LongType()), *(T.StructField(n, t) for n, t in zip(rest_names, types))])
    done = joined.mapInArrow(tidy(_removal()), schema)
    back = dict(zip(rest, rest_names))
    return done.select(*[F.col("text" if c == text else back[c]).alias(c) for c in docs.columns], F.col("n").alias(ours[0]), F.col("r").alias(ours[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's text without repeated sentences and passages."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), passage=PASSAGE)
    return out.select("doc_id", "text", "n_sentences", "n_removed", F.char_length("text").cast("long").alias("n_chars"))
