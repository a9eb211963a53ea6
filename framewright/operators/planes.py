"""Effects on frames in plane form: numpy over Arrow batches, a row per frame. This is the path for whole frames.

A kernel takes the planes of one frame as arrays and returns its red, green and blue. Memory is bound by a frame; there is no shuffle.
Results equal those of pixel form, whose SQL checks them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.pixels import FIXED_POINT, REAL, edge_multiplier

Planes = tuple[np.ndarray, np.ndarray, np.ndarray]
Kernel = Callable[[Planes], np.ndarray]
SCHEMA = "frame_id bigint, width int, height int, rgb binary"
#: About how many bytes of results a batch has that a task hands on.
OUT_BYTES = 4 << 20


def _shifted(y: np.ndarray, u: np.ndarray, v: np.ndarray, rv: int, gv: int, gu: int, bu: int) -> np.ndarray:
    u, v = u - 128, v - 128
    return np.clip(np.stack([y + (rv * v >> 8), y - ((gv * v + gu * u) >> 8), y + (bu * u >> 8)]), 0, 255)


def rgb_fixed(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _shifted(y, u, v, *FIXED_POINT["fixed"])


def rgb_trunc(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    u, v = u - 128, v - 128
    rv, gv, gu, bu = REAL["trunc"]
    return np.clip(np.stack([y + rv * v, y - gv * v - gu * u, y + bu * u]), 0, 255).astype(np.int64)


def square_sum(x: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares cut at the border, by two differences of running sums."""
    for axis in (0, 1):
        x = np.moveaxis(x, axis, 0)
        total = np.concatenate([np.zeros_like(x[:1]), np.cumsum(x, 0)])
        at = np.arange(len(x))
        x = np.moveaxis(total[np.minimum(at + radius + 1, len(x))] - total[np.maximum(at - radius, 0)], 0, axis)
    return x


def edge(y: np.ndarray) -> np.ndarray:
    """The 8-neighbour edge strength of luma, 0 at the border."""
    out = np.clip(edge_multiplier(y.shape[1]) * (9 * y - square_sum(y, 1)), 0, 255)
    out[[0, -1]], out[:, [0, -1]] = 0, 0
    return out


def edge_luminance(planes: Planes) -> np.ndarray:
    return rgb_fixed(edge(planes[0]), *planes[1:])


def convolve3x3(y: np.ndarray, taps: tuple[float, ...]) -> np.ndarray:
    """The 3 x 3 convolution of luma with replicated borders, rounded and clamped."""
    padded, total = np.pad(y, 1, "edge").astype(float), np.zeros(y.shape)
    for k, c in enumerate(taps):
        if c:
            total = total + padded[k // 3 : k // 3 + y.shape[0], k % 3 : k % 3 + y.shape[1]] * c
    return np.clip(np.floor(total + 0.5), 0, 255).astype(np.int64)


CHANNELS = ("MIN", "RED", "GREEN", "BLUE", "MAX")


def permute(planes: Planes, order: tuple[str, str, str], flip: bool) -> np.ndarray:
    y, u, v = planes
    if flip:
        u, v = -u & 255, -v & 255
    r, g, b = rgb_trunc(y, u, v)
    return np.stack([(np.zeros_like(r), r, g, b, np.full_like(r, 255))[CHANNELS.index(s)] for s in order])


def resized(planes: Planes, width: int, height: int) -> Planes:
    """The frame at another size, bilinear and rounded down; chroma is resized at half size. The same size gives the frame itself."""
    y, *chroma = planes
    if y.shape == (height, width):
        return planes

    def to(x: np.ndarray, w: int, h: int) -> np.ndarray:
        old_h, old_w = x.shape
        ys, xs = np.arange(h) * old_h, np.arange(w) * old_w
        y1, fy, x1, fx = ys // h, (ys % h)[:, None], xs // w, xs % w
        y2, x2 = np.minimum(y1 + 1, old_h - 1), np.minimum(x1 + 1, old_w - 1)
        top = x[y1][:, x1] * (w - fx) + x[y1][:, x2] * fx
        low = x[y2][:, x1] * (w - fx) + x[y2][:, x2] * fx
        return (top * (h - fy) + low * fy) // (w * h)

    half = [to(c[::2, ::2], -(-width // 2), -(-height // 2)) for c in chroma]
    return to(y, width, height), *(c.repeat(2, 0).repeat(2, 1)[:height, :width] for c in half)


def _cell_sizes(width: int, height: int, columns: int, least: int) -> tuple[int, int, int, int]:
    """Columns, rows and the size of cells, as numbers.char_grid() has them for a frame that isn't turned; one of each at least."""
    n = max(1, min(columns, width // least))
    w = width // n
    h = min((w * 18 + 5) // 10, height)
    return n, height // h, w, h


def _cell_means(x: np.ndarray, n: int, rows: int, w: int, h: int) -> np.ndarray:
    return x[: rows * h, : n * w].reshape(rows, h, n, w).sum((1, 3)) // (w * h)


def _glyphs(idx: np.ndarray, n_chars: int, w: int, h: int) -> np.ndarray:
    """Which pixels of a grid of cells its characters turn on: those of glyphs.block_glyphs()."""
    on = (h - np.arange(h))[None, :] * (n_chars - 1) <= np.arange(n_chars)[:, None] * h
    return on[idx].transpose(0, 2, 1).reshape(-1, idx.shape[1]).repeat(w, 1)


def glyph_frame(planes: Planes, columns: int, least: int, n_chars: int, mode: str, text: tuple[int, int, int], back: tuple[int, int, int]) -> np.ndarray:
    """Characters by luma, in a colour by mode, over a background."""
    y = planes[0]
    size = _cell_sizes(y.shape[1], y.shape[0], columns, least)
    idx = np.minimum(n_chars - 1, _cell_means(y, *size) * n_chars // 255)
    if mode == "fixed":
        ink = np.array(text)[:, None, None] + np.zeros(idx.shape, np.int64)
    else:
        ink = np.stack([_cell_means(c, *size) for c in _shifted(*planes, *FIXED_POINT["glyph_fixed"])])
        if mode == "primary":
            ink = np.where(ink >= ink.max(0) * 7 // 8, 255, 0)
    on = _glyphs(idx, n_chars, *size[2:])
    return np.where(on, ink.repeat(size[3], 1).repeat(size[2], 2), np.array(back)[:, None, None])


def rain_frame(planes: Planes, columns: int, least: int, text: tuple[int, int, int], edges: bool) -> np.ndarray:
    """Cells of one colour by their luma, or by the edges of the grid of cells: what drops fall in front of."""
    y = planes[0]
    size = _cell_sizes(y.shape[1], y.shape[0], columns, least)
    luma = _cell_means(y, *size)
    if edges:
        luma = np.clip(4 * (9 * luma - square_sum(luma, 1)), 0, 255)
        luma[[0, -1]], luma[:, [0, -1]] = 0, 0
    ink = np.stack([luma * c // 255 for c in text])
    return ink.repeat(size[3], 1).repeat(size[2], 2)


def cartoon(planes: Planes, radius: int = 4) -> np.ndarray:
    out = (2 * rgb_trunc(*planes) + 85) // 170 * 85
    for axis in (2, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (radius + 1, radius)
        total = np.cumsum(np.pad(out, pad, "edge"), axis)
        n = out.shape[axis]
        out = (np.take(total, range(2 * radius + 1, 2 * radius + 1 + n), axis) - np.take(total, range(n), axis)) // (2 * radius + 1)
    return out


#: Most counts that a histogram of a tile holds.
MOST_COUNTS = 8 << 20


def disc_modes(code: np.ndarray, radius: np.ndarray, margin: int) -> np.ndarray:
    """The most frequent number in the disc around each place, the least of those that tie; radius: each place's disc.

    code is larger than radius by a margin on all sides, no less than any radius; negative numbers there don't count. Histograms of all places of a row slide down
    the frame: for each column of the disc the number above it is dropped and the one below it added. A frame with too many numbers for
    that is cut into tiles, which know only their own.
    """
    height, width = radius.shape
    names, own = np.unique(code, return_inverse=True)
    if len(names) * width > MOST_COUNTS and max(height, width) > 16:
        out, axis = np.empty_like(radius), int(width >= height)
        half = radius.shape[axis] // 2
        for lo, hi in ((0, half), (half, radius.shape[axis])):
            part, with_margin = (slice(lo, hi),), (slice(lo, hi + 2 * margin),)
            part, with_margin = ((slice(None), *part), (slice(None), *with_margin)) if axis else (part, with_margin)
            out[part] = disc_modes(code[with_margin], radius[part], margin)
        return out
    own, none, xs, out = own.reshape(code.shape), int((names < 0).sum()), np.arange(width), np.empty_like(radius)
    for size in np.unique(radius).tolist():
        wanted = radius == size
        rows = np.flatnonzero(wanted.any(1))
        # all columns of the disc in one step each way: what a call of numpy costs would otherwise be paid for each of them
        dx = np.arange(-size, size + 1)
        reach = np.array([math.isqrt(size * size - d * d) for d in dx.tolist()])
        counts, one = np.zeros((width, len(names)), np.uint16), np.uint16(1)
        flat, first, across = counts.reshape(-1), xs * len(names), xs + margin + dx[:, None]
        at = lambda y, which=slice(None): (first + own[np.broadcast_to(y + margin, dx.shape)[which, None], across[which]]).ravel()
        for step in range(-size, size + 1):
            np.add.at(flat, at(rows[0] + step, reach >= abs(step)), one)
        for y in range(rows[0], rows[-1] + 1):
            here = np.flatnonzero(wanted[y])
            if len(here):
                out[y, here] = names[counts[here, none:].argmax(1) + none]
            if y < rows[-1]:
                np.subtract.at(flat, at(y - reach), one)
                np.add.at(flat, at(y + 1 + reach), one)
    return out


def oil_mode(planes: Planes, brush: int = 4, levels: int = 48, sensitivity: float = 1.5) -> np.ndarray:
    """Each pixel gets the most frequent colour of its disc, the smallest of those that tie."""
    rgb = rgb_fixed(*planes)
    b = rgb[0] * 299 + rgb[1] * 587 + rgb[2] * 114
    n = square_sum(np.ones_like(b), 3)
    spread = square_sum(b * b, 3) - 2 * b * square_sum(b, 3) + n * b * b
    share = np.minimum(1.0, spread / (n * 65025e6))
    radius = np.clip(np.floor(brush * (1.0 - np.minimum(0.8, share * sensitivity))).astype(int), 2, brush)
    step = 256 // levels
    r, g, bl = rgb // step * step
    colour = disc_modes(np.pad(r * 65536 + g * 256 + bl, brush, constant_values=-1), radius, brush)
    return np.stack([colour >> 16, colour >> 8 & 255, colour & 255])


def _jitter(seg: np.ndarray, k: int, most: int) -> np.ndarray:
    return ((seg * 8 + k) * 1103515245 + 12345) % (1 << 31) // 65536 % (2 * most + 1) - most


@functools.lru_cache(maxsize=4)
def segment_map(width: int, height: int, spacing: int) -> np.ndarray:
    """The segment of each pixel: the same for all frames of a size, so the last few are kept; not to be written to."""
    cx, cy = (len(range(spacing // 2, n, spacing)) for n in (width, height))
    seg = np.arange(cx * cy)
    sx = np.clip(seg % cx * spacing + spacing // 2 + _jitter(seg, 0, spacing // 3), 0, width - 1)
    sy = np.clip(seg // cx * spacing + spacing // 2 + _jitter(seg, 1, spacing // 3), 0, height - 1)
    y, x = np.mgrid[:height, :width]
    best, out = np.full((height, width), np.iinfo(np.int64).max), np.zeros((height, width), np.int64)
    for dy in (-1, 0, 1):  # ascending segments, so that the first of equals stays
        for dx in (-1, 0, 1):
            gx, gy = x // spacing + dx, y // spacing + dy
            there = (gx >= 0) & (gx < cx) & (gy >= 0) & (gy < cy)
            s = np.where(there, gy * cx + gx, 0)
            d = np.where(there, (x - sx[s]) ** 2 + (y - sy[s]) ** 2, np.iinfo(np.int64).max)
            out = np.where(d < best, s, out)
            best = np.minimum(d, best)
    out.flags.writeable = False
    return out


def stained_glass(planes: Planes, spacing: int = 8, thickness: int = 2, edge_colour: tuple[int, int, int] = (20, 30, 40), variation: int = 12) -> np.ndarray:
    rgb = rgb_fixed(*planes)
    height, width = rgb.shape[1:]
    seg = segment_map(width, height, spacing)
    n = np.bincount(seg.ravel(), minlength=seg.max() + 1)
    means = [np.bincount(seg.ravel(), c.ravel(), len(n)).astype(np.int64) // np.maximum(n, 1) for c in rgb]
    out = np.stack([np.clip(m + _jitter(np.arange(len(n)), 2 + k, variation), 0, 255)[seg] for k, m in enumerate(means)])
    edge = np.zeros(seg.shape, bool)
    right, below = seg[:-1, 1:] != seg[:-1, :-1], seg[1:, :-1] != seg[:-1, :-1]
    for t in range(thickness):
        edge[:-1, t : t + width - 1] |= right[:, : width - t][:, : edge[:-1, t : t + width - 1].shape[1]]
        edge[t : t + height - 1, :-1] |= below[: edge[t : t + height - 1, :-1].shape[0]]
    return np.where(edge, np.array(edge_colour)[:, None, None], out)


KERNELS: dict[str, Kernel] = {"edge_luminance": edge_luminance, "cartoon": cartoon, "oil_mode": oil_mode, "stained_glass": stained_glass}


def whole_planes(width: int, height: int, y: bytes, u: bytes, v: bytes) -> Planes:
    """Binary planes as arrays of the frame's size, chroma repeated."""
    half = -(-height // 2), -(-width // 2)
    luma = np.frombuffer(y, np.uint8).reshape(height, width).astype(np.int64)
    return luma, *(np.frombuffer(p, np.uint8).reshape(half).repeat(2, 0).repeat(2, 1)[:height, :width].astype(np.int64) for p in (u, v))


def apply(planes: DataFrame, kernel: Kernel) -> DataFrame:
    """(frame_id, width, height, rgb): interleaved bytes of every frame's result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["frame_id", "width", "height", "rgb"]
        for batch in batches:
            made, first, size = [], 0, 0
            for row, (w, h, *parts) in enumerate(zip(*(batch.column(k) for k in range(1, 6)))):
                w, h, *parts = (x.as_py() for x in (w, h, *parts))
                made.append(np.moveaxis(kernel(whole_planes(w, h, *parts)), 0, 2).astype(np.uint8).tobytes())
                size += len(made[-1])
                if size >= OUT_BYTES or row == batch.num_rows - 1:
                    own = batch.slice(first, len(made))
                    yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(made, pa.binary())], names)
                    made, first, size = [], row + 1, 0

    return planes.select("frame_id", "width", "height", "yp", "up", "vp").mapInArrow(run, SCHEMA)


def rgb_pixels(result: DataFrame) -> DataFrame:
    """(frame_id, x, y, r, g, b) of apply()'s frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, w, h, data in zip(*(c.to_pylist() for c in batch.columns)):
                px = np.frombuffer(data, np.uint8).reshape(h * w, 3).astype(np.int64)
                at = np.arange(h * w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, frame)), pa.array(at % w), pa.array(at // w), *(pa.array(px[:, k]) for k in range(3))], ["frame_id", "x", "y", "r", "g", "b"])

    return result.mapInArrow(run, "frame_id bigint, x bigint, y bigint, r bigint, g bigint, b bigint")
