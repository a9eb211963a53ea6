"""Words of Arrow string columns as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D, the pattern ``[^\\x20\\x09-\\x0D]+``. White space of
that kind is ASCII, so splitting the UTF-8 bytes equals splitting the characters. Nothing here loops over
words in Python; a batch is cut into chunks of about a megabyte so that temporary arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output (splitmix64's finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=_U)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """The words of one chunk. ``offset[d]:offset[d + 1]`` are those of document d of the chunk."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        solid = ~_SPACE[data]
        before = np.empty_like(solid)
        before[:1], before[1:] = False, solid[:-1]
        inner = bounds[1:-1]
        before[inner[inner < len(data)]] = False
        after = np.empty_like(solid)
        after[-1:], after[:-1] = False, solid[1:]
        after[inner[inner > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.offset = np.searchsorted(self.start, bounds)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.offset)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.count)

    def spans_hash(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, whatever its place in the chunk."""
        if not len(start):
            return np.zeros(0, _U)
        up, down = powers(len(self.data) + 1)
        codes = _BYTE_CODE[_LOWER[self.data] if lower else self.data]
        codes *= up[: len(codes)]
        prefix = np.zeros(len(codes) + 1, _U)
        np.cumsum(codes, out=prefix[1:])
        return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U))

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.spans_hash(self.start, self.end, lower)

    def chars_before(self) -> np.ndarray:
        """The number of code points before each byte: those bytes that don't continue one."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def grams(hashes: np.ndarray, offset: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and for each document the first and end of its runs."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, _U), np.zeros(len(offset), np.int64)
    runs = hashes[:size].copy()
    for k in range(1, n):
        runs *= _U(0x9E3779B97F4A7C15)
        runs += hashes[k : k + size]
    count = np.maximum(np.diff(offset) - (n - 1), 0)
    out = np.zeros(len(offset), np.int64)
    np.cumsum(count, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(offset[:-1] - out[:-1], count)
    return mix64(runs[at]), out


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first, end, words) for successive ranges of documents of about ``limit`` bytes; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, Words(data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first])
        first = end
