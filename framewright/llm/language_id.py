"""Language identification of mixed-language text.

A word's script (by the ranges of code points whose Unicode names begin alike) narrows the languages that it may belong to. Each word is scored under each of them by
its byte trigrams, whose log frequencies are learned from labelled documents, and Viterbi's algorithm with a penalty for each
switch of language labels spans of words. A document's language is the one that most of its letters are in.

Learning counts trigrams in a table of fixed size for each language; labelling reads each text once, without a shuffle. Viterbi
steps through the words of many documents at once in numpy, so its state is a few numbers a document.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import gathered, passed, small_batches
from ._words import _LOWER, _SPACE, Words, chunks, mix64

BUCKETS = 1 << 15
SWITCH = 8.0
#: A language may use a script if so large a share of its training words does.
LEAST_SHARE = 0.005
GROUP_BYTES = 8 << 20
_U = np.uint64


@functools.cache
def script_table() -> tuple[list[str], np.ndarray]:
    """The names of scripts, and the script of each code point: 0 if it is no letter, else that of its Unicode name's first word."""
    names, table = {"": 0}, np.zeros(sys.maxunicode + 1, np.int16)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            table[code] = names.setdefault(unicodedata.name(char, "UNNAMED").split(" ")[0].split("-")[0], len(names))
    return list(names), table


def scripts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The script of each word's first letter (0: it has none), and its number of letters."""
    if not len(words.start):
        return np.zeros(0, np.int16), np.zeros(0, np.int64)
    data, table = words.data, script_table()[1]
    kind = np.where(data < 0x80, table[data], 0)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        rest = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        two, three = (first & 0x1F) << 6 | rest[0], (first & 0x0F) << 12 | rest[0] << 6 | rest[1]
        four = (first & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
        kind[lead] = table[np.minimum(np.where(first < 0xE0, two, np.where(first < 0xF0, three, four)), sys.maxunicode)]
    letter = kind > 0
    count = np.concatenate([[0], np.cumsum(letter)])
    letters = count[words.end] - count[words.start]
    first = np.flatnonzero(letter)
    at = np.minimum(np.searchsorted(first, words.start), max(0, len(first) - 1))
    return np.where(letters > 0, kind[first[at]] if len(first) else 0, 0), letters


def trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each byte that isn't white space, and how many of these each word has."""
    data = np.where(_SPACE[words.data], 32, _LOWER[words.data]).astype(np.int64)
    before, after = np.empty_like(data), np.empty_like(data)
    before[:1], before[1:], after[-1:], after[:-1] = 32, data[:-1], 32, data[1:]
    inner = words.bounds[1:-1]
    before[inner[inner < len(data)]] = 32
    after[inner[inner > 0] - 1] = 32
    code = (mix64((before << 16 | data << 8 | after).astype(_U)) >> _U(49)).astype(np.int64)
    return code[data != 32], words.end - words.start


@dataclass
class Model:
    languages: list[str]
    log: np.ndarray  # (BUCKETS, languages)
    may: np.ndarray  # (scripts, languages): whether a language uses a script


def viterbi(score: np.ndarray, offset: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word: the path of greatest score, less ``switch`` for each change. offset: documents' words."""
    n, width = score.shape
    count = np.diff(offset)
    order = np.argsort(-count, kind="stable")
    longest = int(count[order[0]]) if len(order) else 0
    active = np.searchsorted(-count[order], -np.arange(1, longest + 1), "right")  # documents with a t-th word
    start = offset[:-1][order]
    best = np.zeros((len(order), width), score.dtype)
    came = np.empty((n, width), np.int16)
    label = np.arange(width, dtype=np.int16)
    for t in range(longest):
        k = active[t]
        now = best[:k]
        if t:
            top = now.argmax(1)
            limit = now[np.arange(k), top] - switch
            stay = now >= limit[:, None]
            came[start[:k] + t] = np.where(stay, label, top[:, None])
            now = np.where(stay, now, limit[:, None])
        best[:k] = now + score[start[:k] + t]
    out = np.empty(n, np.int16)
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return out


def _count(languages: list[str]):
    """Arrow rows (lang, text) -> (kind 0: trigram, 1: script; bucket; language; n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, used = np.zeros((len(languages), BUCKETS), np.int64), np.zeros((len(languages), len(script_table()[0])), np.int64)
        number = {name: k for k, name in enumerate(languages)}
        for batch in batches:
            own = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, words in chunks(batch.column(1)):
                code, size = trigrams(words)
                lang = np.repeat(own[lo:hi], words.count)
                script, _ = scripts(words)
                for k in np.unique(lang):
                    mine = lang == k
                    seen[k] += np.bincount(code[np.repeat(mine, size)], minlength=BUCKETS)
                    used[k] += np.bincount(script[mine], minlength=used.shape[1])
        for kind, table in ((0, seen), (1, used)):
            k, at = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(table[k, at])], ["kind", "bucket", "lang", "n"])

    return run


def learn(docs: DataFrame, text: str, lang: str) -> Model:
    """The model of documents whose lang isn't null; languages are taken to be few (their names come to the driver)."""
    labelled = docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if len(languages) > np.iinfo(np.int16).max:
        raise ValueError(f"{len(languages)} languages; labels are numbers of 16 bits")
    found = gathered(labelled).mapInArrow(_count(languages), "kind int, bucket int, lang int, n bigint").groupBy("kind", "bucket", "lang").agg(F.sum("n").alias("n")).toPandas()
    seen, used = np.zeros((BUCKETS, len(languages))), np.zeros((len(script_table()[0]), len(languages)))
    for kind, table in ((0, seen), (1, used)):
        part = found[found["kind"] == kind]
        table[part["bucket"], part["lang"]] = part["n"]
    # between a language's own frequencies and all languages', so that what one has never shown isn't impossible
    overall = (seen.sum(1, keepdims=True) + 0.5) / (seen.sum() + 0.5 * BUCKETS)
    log = np.log((seen + 50 * overall) / (seen.sum(0) + 50)).astype(np.float32)
    may = used > LEAST_SHARE * used.sum(0)
    may[~may.any(1)] = True
    may[0] = True
    return Model(languages, log, may)


@dataclass
class _Held:
    first: int
    score: np.ndarray
    letters: np.ndarray
    count: np.ndarray


def _label(shared: Broadcast):
    """Arrow rows (id, held_out, text) -> (id, held_out, lang_pred, score, n_spans)."""

    def decide(model: Model, held: list[_Held], batch: pa.RecordBatch) -> pa.RecordBatch:
        first, count = held[0].first, np.concatenate([h.count for h in held])
        score, letters = np.concatenate([h.score for h in held]), np.concatenate([h.letters for h in held])
        offset = np.concatenate([[0], np.cumsum(count)])
        path = viterbi(score, offset, SWITCH)
        doc = np.repeat(np.arange(len(count)), count)
        width = len(model.languages)
        share = np.bincount(doc * width + path, letters, minlength=len(count) * width).reshape(len(count), width)
        change = np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])])[: len(path)]
        total = share.sum(1)
        best = share.argmax(1)
        names = [model.languages[k] if t else "und" for k, t in zip(best, total)]
        own = np.divide(share[np.arange(len(count)), best], total, out=np.zeros(len(count)), where=total > 0)
        spans = np.bincount(doc[change], minlength=len(count))
        part = batch.slice(first, len(count))
        return pa.RecordBatch.from_arrays([passed(part.column(0)), part.column(1), pa.array(names, pa.string()), pa.array(own), pa.array(spans)], ["id", "held_out", "lang_pred", "score", "n_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            held, size = [], 0
            for lo, _, words in chunks(batch.column(2)):
                code, length = trigrams(words)
                script, letters = scripts(words)
                begin = np.cumsum(length) - length
                score = np.add.reduceat(model.log[code], begin, axis=0) if len(begin) else np.zeros((0, len(model.languages)), np.float32)
                score[script == 0] = 0  # numbers and signs go with their neighbours
                score[~model.may[script]] -= 1e4
                held.append(_Held(lo, score, letters, words.count))
                size += len(words.data)
                if size >= GROUP_BYTES:
                    yield decide(model, held, batch)
                    held, size = [], 0
            if held:
                yield decide(model, held, batch)

    return run


def _no_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([passed(batch.column(0)), batch.column(1), pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64))], ["id", "held_out", "lang_pred", "score", "n_spans"])


def language_id(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each row of docs: id, held_out, lang_pred, score (the share of letters in that language), n_spans.

    Learns from rows with a lang whose crc32(id as text) modulo 5 isn't 0 (held_out: it is 0; a null id counts as the empty text).
    lang_pred is ``und``, with a score of 0, if the text is null or has no letter, or nothing was learned. Of equal shares the language
    first by name wins. Repeated rows are labelled one by one; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    held = F.pmod(F.crc32(F.coalesce(docs[id].cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    model = learn(docs.filter(~held), text, lang)
    source = docs.select(docs[id].alias("id"), held.alias("held_out"), docs[text].alias("text"))
    label = _label(docs.sparkSession.sparkContext.broadcast(model)) if model.languages else _no_model  # BUCKETS numbers a language
    out = source.mapInArrow(label, f"id {kind}, held_out boolean, lang_pred string, score double, n_spans bigint")
    return out.withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the predicted language of every document."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
