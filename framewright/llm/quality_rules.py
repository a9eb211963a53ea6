"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths tell which characters of a text lie inside n-grams and lines that
it has had before; a text that repeats itself too much, is too short or is full of symbols is rejected. One pass
over the documents without a shuffle, in numpy over Arrow batches: memory is bound by a batch and one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._spark import free_name, passed, small_batches, tidy
from ._words import Words, chunks, grams, mix64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the verdict, as shares of the characters in words.

    covered: {n: share inside n-grams seen before in the text}; top: {n: share of the most frequent n-gram, if it
    comes at least twice}; line_chars, lines: share of characters, of lines, in lines seen before (two lines at least).
    """

    min_words: int = 20
    window: int = 8
    window_percent: int = 30
    covered: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10})
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    line_chars: float = 0.20
    lines: float = 0.30
    symbols_per_word: float = 0.10


MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "dup_gram_chars": "double", "top_gram_chars": "double", "dup_line_chars": "double", "kept": "boolean",
}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _seen(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the hashes of each document: whether one came before, whether it comes twice or more, how often it comes."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    key = hashes ^ mix64(doc + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = np.diff(key[order]) != 0
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    before, often = np.empty(n, bool), np.empty(n, np.int64)
    before[order], often[order] = ~new, np.repeat(size, size)
    return before, often > 1, often


def _covered(marked: np.ndarray, bounds: np.ndarray, words: Words, n: int) -> np.ndarray:
    """Which words lie in a marked run of n words."""
    step = np.zeros(len(words.start) + 1, np.int64)
    count = np.diff(bounds)
    at = (np.arange(bounds[-1]) + np.repeat(words.offset[:-1] - bounds[:-1], count))[marked]
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(words: Words, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """MEASURES of the documents of a chunk."""
    data, offset, n_words = words.data, words.offset, words.count
    before = words.chars_before()
    chars = before[words.end] - before[words.start]
    word_chars = _sums(chars, offset)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": _sums(_SYMBOL[data], words.bounds)}
    share = lambda part, of: np.divide(part, of, out=np.zeros(len(of)), where=of > 0)

    # lines, cut at \n and at documents' ends
    cut = np.unique(np.concatenate([words.bounds, np.flatnonzero(data == 10) + 1]))
    start, end = cut[:-1], cut[1:].copy()
    if len(start):
        end -= data[end - 1] == 10
    in_line = np.searchsorted(words.start, end) - np.searchsorted(words.start, start)
    start, end = start[in_line > 0], end[in_line > 0]
    of = np.searchsorted(start, words.bounds)
    again = _seen(words.spans_hash(start, end), of)[0]
    lines = np.diff(of)
    out["n_dup_lines"] = _sums(again, of)
    first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    total = np.concatenate([[0], np.cumsum(chars)])
    dup_line = share(_sums(np.where(again, total[last] - total[first], 0), of), word_chars)

    hashes = words.hashes()
    bad = (dup_line > rules.line_chars) | ((out["n_dup_lines"] > 1) & (share(out["n_dup_lines"], lines) > rules.lines))
    worst, top = np.zeros(len(n_words)), np.zeros(len(n_words))
    for n in sorted({*rules.covered, rules.window}):
        runs, bounds = grams(hashes, offset, n)
        was, twice, _ = _seen(runs, bounds)
        if n == rules.window:
            out["n_repeat_words"] = _sums(_covered(twice, bounds, words, n), offset)
        if n in rules.covered:
            x = share(_sums(np.where(_covered(was, bounds, words, n), chars, 0), offset), word_chars)
            worst, bad = np.maximum(worst, x), bad | (x > rules.covered[n])
    for n, limit in rules.top.items():
        runs, bounds = grams(hashes, offset, n)
        often = _seen(runs, bounds)[2]
        if len(often):
            count = np.diff(bounds)
            at = np.arange(bounds[-1]) + np.repeat(offset[:-1] - bounds[:-1], count)
            size = np.where(often > 1, often * (total[at + n] - total[at]), 0)
            most = np.zeros(len(n_words), np.int64)
            some = count > 0
            most[some] = np.maximum.reduceat(size, bounds[:-1][some])
            # overlapping occurrences ("a a a") may add up to more than the text
            x = np.minimum(share(most, word_chars), 1.0)
            top, bad = np.maximum(top, x), bad | ((x > limit) & (n_words > 4 * n))
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.window_percent * n_words)
    bad |= out["n_symbols"] > rules.symbols_per_word * n_words
    return out | {"dup_gram_chars": worst, "top_gram_chars": top, "dup_line_chars": dup_line, "kept": ~out["base_failed"] & ~bad}


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: RepetitionRules | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all but the text by default) and MEASURES.

    A null or empty text has no words and fails. Repeated rows are measured one by one. A column of docs named as a
    measure is returned under that name with underscores before the measure. An empty table gives no rows.
    """
    rules = rules or RepetitionRules()
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rest = docs.select(*keep)
    names = {m: free_name(rest, m) for m in MEASURES}
    schema = T.StructType([*rest.schema.fields, *(T.StructField(names[m], T._parse_datatype_string(t)) for m, t in MEASURES.items())])
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    small_batches(docs.sparkSession)
    place = [1 + [c for c in keep if c != text].index(c) if c != text else 0 for c in keep]
    source = docs.select(docs[text].alias(free_name(docs, "text_")), *[c for c in keep if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words in chunks(batch.column(0)):
                m = measure(words, rules)
                own = [pa.array(m[k], arrow[t]) for k, t in MEASURES.items()]
                yield pa.RecordBatch.from_arrays([*(passed(batch.column(k).slice(first, end - first)) for k in place), *own], [*keep, *names.values()])

    return source.mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the measures and the verdict of every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
