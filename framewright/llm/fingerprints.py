"""Document fingerprints from prefix polynomial hashes.

A text's prefix hashes modulo two primes give the hash of any span by one subtraction and one multiplication, so spans of
two texts are compared, and their longest common extensions located by binary search, without looking at characters again.
A fingerprint holds the text's length and hash and the SKETCH least hashes of its spans of SPAN code points; those of texts shorter
than BRIEF also hold the least hashes of spans of SHORT_SPAN. Two fingerprints tell how many of the spans the texts share, of the short
ones if both have them.

Documents are put in order by ranges, whose bounds are rows picked by a hash, about the square root of their number. Each text is
shuffled once, to its range, and the row at each bound to the range before too, whose last row it follows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import passed, small, small_batches
from ._words import mix64

SPAN, SKETCH = 16, 64
SHORT_SPAN, BRIEF = 4, 128
#: One of so many picked rows is a bound, so that ranges are of about the same size.
EVEN = 8
_U = np.uint64
_P1, _P2 = (1 << 31) - 1, (1 << 31) - 19
_B1, _B2 = 911_382_323, 972_663_749
_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _mod1(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62: the number's halves add up."""
    p, s = _U(_P1), _U(31)
    x = (x & p) + (x >> s)
    x = (x & p) + (x >> s)
    return np.where(x == p, _U(0), x)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo prime, by doubling."""
    known = _TABLES.get((base, prime), np.ones(1, _U))
    while len(known) < n:
        known = np.concatenate([known, known * _U(pow(base, len(known), prime)) % _U(prime)])
    _TABLES[base, prime] = known
    return known[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHash:
    """prefix hashes of code points: at[i] is the sum of (c[j] + 1) * base**j over j < i, modulo each prime.

    after: a text whose first ``kept`` code points the new one begins with; its prefix hashes of these are taken over.
    """

    def __init__(self, codes: np.ndarray, after: PrefixHash | None = None, kept: int = 0):
        self.n = n = len(codes)
        c = codes[kept:].astype(_U) + _U(1)
        self.one, self.two = np.zeros(n + 1, _U), np.zeros(n + 1, _U)
        if kept:
            self.one[: kept + 1], self.two[: kept + 1] = after.one[: kept + 1], after.two[: kept + 1]
        # terms below 2**31 add up to less than 2**64 for any text that fits in memory
        one, two = np.cumsum(_mod1(c * _powers(_B1, _P1, n)[kept:])), np.cumsum(c * _powers(_B2, _P2, n)[kept:] % _U(_P2))
        self.one[kept + 1 :], self.two[kept + 1 :] = _mod1(one + self.one[kept]), (two + self.two[kept]) % _U(_P2)

    def span(self, start: int, end: int, shift: int) -> tuple[int, int]:
        """The hash of a span as if it stood ``shift`` places further on, modulo each prime."""
        a = (int(self.one[end]) - int(self.one[start])) * pow(_B1, shift, _P1) % _P1
        return a, (int(self.two[end]) - int(self.two[start])) * pow(_B2, shift, _P2) % _P2

    def windows(self, size: int, first: int = 0) -> np.ndarray:
        """31-bit hashes of all spans of one size from the first on."""
        n = max(0, self.n - size + 1)
        shift = _powers(pow(_B1, -1, _P1), _P1, n)[first:]
        return _mod1((self.one[size + first :] + _U(_P1) - self.one[first:n]) * shift)

    def whole(self) -> int:
        return int(self.one[-1]) << 31 | int(self.two[-1])


def equal(x: PrefixHash, i: int, y: PrefixHash, j: int, n: int) -> bool:
    """Whether n code points of x from i equal those of y from j."""
    low = min(i, j)
    return x.span(i, i + n, j - low) == y.span(j, j + n, i - low)


def common_extension(x: PrefixHash, i: int, y: PrefixHash, j: int) -> int:
    """The length of the longest common extension of x from i and y from j."""
    lo, hi = 0, min(x.n - i, y.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal(x, i, y, j, mid) else (lo, mid - 1)
    return lo


def spans(x: PrefixHash, size: int, after: np.ndarray | None = None, kept: int = 0) -> np.ndarray:
    """Mixed 32-bit hashes of all spans of a size; of a shorter text, that of the whole; of an empty one, none.

    after: those of a text whose first ``kept`` code points x begins with."""
    if not x.n:
        return np.zeros(0, np.uint32)
    size = min(size, x.n)
    same = max(0, kept - size + 1) if after is not None else 0
    own = (mix64(x.windows(size, same) + _U(1)) >> _U(32)).astype(np.uint32)
    return np.concatenate([after[:same], own]) if same else own


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least SKETCH distinct hashes, ascending."""
    some = 2 * SKETCH
    while some < len(hashes):
        # about so many lie below the limit, unless they repeat
        least = np.unique(hashes[hashes < (1 << 32) // len(hashes) * some])
        if len(least) >= SKETCH:
            return least[:SKETCH]
        some *= 8
    return np.unique(hashes)[:SKETCH]


Sketches = tuple[np.ndarray, np.ndarray | None]


def sketches(x: PrefixHash) -> Sketches:
    return sketch(spans(x, SPAN)), sketch(spans(x, SHORT_SPAN)) if x.n < BRIEF else None


def fingerprint(x: PrefixHash, least: Sketches) -> str:
    parts = [base64.b64encode(s.astype("<u4").tobytes()).decode() for s in least if s is not None]
    return f"{x.n}.{x.whole():016x}.{'.'.join(parts)}"


def _shared(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.concatenate([x, y])
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    rank = np.cumsum(first)  # of each value among the distinct ones
    # a value counts among the least SKETCH of the union; beyond a shorter sketch nothing is known to be missing
    return float((twice & (rank[1:] <= SKETCH)).sum() / min(SKETCH, rank[-1]))


def _likeness(x: Sketches, y: Sketches) -> float:
    return _shared(x[1], y[1]) if x[1] is not None and y[1] is not None else _shared(x[0], y[0])


def likeness(x: str, y: str) -> float:
    """The share of spans that the texts of two fingerprints have in common, 0 to 1: 1 for equal texts."""
    read = lambda f: [np.frombuffer(base64.b64decode(p), "<u4") for p in f.split(".")[2:]]
    return _likeness(*((*s, None)[:2] for s in (read(x), read(y))))


def _follow():
    """Arrow rows (range, guest, id, text), sorted -> the result. A range's last row follows on to its guest, the next range's first."""

    class Doc:
        def __init__(self, id, text: str):
            self.id, self.text, self.codes = id, text, code_points(text)
            self.prefix = PrefixHash(self.codes)
            self.spans = spans(self.prefix, SPAN)
            self.least = sketch(self.spans), sketch(spans(self.prefix, SHORT_SPAN)) if len(self.codes) < BRIEF else None

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def row(doc: Doc, after: Doc) -> tuple:
        n = len(doc.codes)
        k = n // 4
        edited = PrefixHash(np.concatenate([doc.codes[: n - k], after.codes[:k]]), doc.prefix, n - k)
        short = sketch(spans(edited, SHORT_SPAN)) if edited.n < BRIEF else None
        # spans of a text shorter than one are its whole, which an edit changes
        least = sketch(spans(edited, SPAN, doc.spans if min(n, edited.n) >= SPAN else None, n - k)), short
        sha = hashlib.sha256((doc.text[: n - k] + after.text[:k]).encode("utf-8", "surrogatepass")).hexdigest()
        return (doc.id, n, sha, fingerprint(doc.prefix, doc.least), fingerprint(edited, least), _likeness(doc.least, least), _likeness(doc.least, after.least),
                common_extension(doc.prefix, 0, edited, 0), common_extension(doc.prefix, 0, after.prefix, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, where = None, None
        for batch in batches:
            out = []
            types[0] = batch.column(2).type
            for place, guest, id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if guest and (last is None or where != place):
                    continue  # a second guest, of equal id and text
                doc = Doc(id, text or "")
                if last is not None and where == place:
                    out.append(row(last, doc))
                last, where = (None if guest else doc), place
            yield pa.RecordBatch.from_arrays([passed(pa.array([r[k] for r in out], t)) for k, t in enumerate(types)], names)

    return run


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs, whose text's last quarter is edited into the beginning of the next one's.

    The next row is that of the next greater id (by its type's order; null last), then text hash; the first follows the last, and a single
    row follows itself. A null text is empty. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    and common_edited, common_next: the lengths of the longest common beginnings. Other columns are ignored; an empty table gives no rows.

    Rows equal in id and text lie in any order, by a number of their own, so that a great many of them make several ranges.
    """
    spark = small_batches(docs.sparkSession)
    source = docs.select(docs[id].alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    key = [F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"), F.xxhash64(F.monotonically_increasing_id()).alias("number")]
    keys = source.select(*key)
    every = max(1, math.isqrt(source.count()) // EVEN)
    picked = F.pmod(F.xxhash64(F.lit(5), "id", "text_hash", "number"), F.lit(every)) == 0
    first = keys.agg(F.min(F.struct("none", "id", "text_hash"))).first()[0]
    bounds = [tuple(r) for r in keys.filter(picked).orderBy("none", "id", "text_hash", "number").collect()]  # a row in ``every``
    bounds = bounds[EVEN - 1 :: EVEN]
    spread = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def range_of(none: pa.Array, own: pa.Array, text_hash: pa.Array, number: pa.Array) -> pa.Array:
        at = spread.value
        return pa.array([bisect.bisect_right(at, k) for k in zip(none.to_pylist(), own.to_pylist(), text_hash.to_pylist(), number.to_pylist())], pa.int32())

    # the row at a bound is the first of its range
    guests = [(*b[1:3], k) for k, b in enumerate(bounds)] + ([(first["id"], first["text_hash"], len(bounds))] if first else [])
    guest = spark.createDataFrame(guests, f"g_id {kind}, g_hash bigint, range int")
    follow = source.join(small(guest, len(guests)), source["id"].eqNullSafe(guest["g_id"]) & (source["text_hash"] == guest["g_hash"]))
    follow = follow.select("range", F.lit(1).alias("guest"), "id", "text_hash", "text").dropDuplicates(["range", "id", "text_hash"])
    placed = source.select(range_of(*key).alias("range"), F.lit(0).alias("guest"), "id", "text_hash", "text")
    sent = placed.union(follow).repartition("range").sortWithinPartitions("range", "guest", F.col("id").asc_nulls_last(), "text_hash")
    columns = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited bigint, common_next bigint"
    return sent.select("range", "guest", "id", "text").mapInArrow(_follow(), columns).withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the fingerprints of every document and its edited text."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
