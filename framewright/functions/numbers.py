"""Scalar rules on sizes, grids, times and names, as columns; and the arithmetic generator that stands for random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixels import col, half_up


def jitter(key: Column, k: int, most: int) -> Column:
    """A number from -most to most that follows from key and k alone (a linear congruential step), the same in any engine."""
    mixed = F.pmod((key.cast("long") * 8 + k) * 1103515245 + 12345, F.lit(1 << 31))
    return (F.pmod(F.floor(mixed / 65536), F.lit(2 * most + 1)) - most).cast("int")


def product_modulo(a: Column, b: Column, bits: int) -> Column:
    """a * b modulo 2**bits, of whole numbers of any size, for up to 42 bits: b goes in two halves, so no product needs more than 63 bits."""
    if not 1 <= bits <= 42:
        raise ValueError("a modulus of 1 to 42 bits")
    m, half = F.lit(1 << bits), bits // 2
    a, b = F.pmod(a.cast("long"), m), F.pmod(b.cast("long"), m)
    high, low = F.shiftright(b, half), F.pmod(b, F.lit(1 << half))
    return F.pmod(F.pmod(F.pmod(a * high, m) * (1 << half), m) + F.pmod(a * low, m), m)


def fit_size(w: Column | str, h: Column | str, to_w: int, to_h: int) -> tuple[Column, Column]:
    """The largest size of the same shape within the target."""
    ratio = F.least(F.lit(float(to_w)) / col(w), F.lit(float(to_h)) / col(h))
    return tuple(half_up(col(x) * ratio).cast("long") for x in (w, h))


def char_grid(w: Column | str, h: Column | str, portrait: Column, preferred: int, least_width: int, tenths: int = 18) -> dict[str, Column]:
    """Columns, rows and cell size of a character grid; a cell is tenths/10 as high as wide."""
    across, down = F.when(portrait, col(h)).otherwise(col(w)), F.when(portrait, col(w)).otherwise(col(h))
    columns = F.least(F.lit(preferred), F.floor(across / least_width))
    cell_w = F.floor(across / columns)
    cell_h = F.floor((cell_w * tenths + 5) / 10)
    rows = F.floor(down / cell_h)
    out = {"n_columns": columns, "n_rows": rows, "cell_w": cell_w, "cell_h": cell_h}
    out["out_w"] = F.when(portrait, rows * cell_h).otherwise(columns * cell_w)
    out["out_h"] = F.when(portrait, columns * cell_w).otherwise(rows * cell_h)
    return {k: v.cast("long") for k, v in out.items()}


def even_up(x: Column) -> Column:
    return x + F.pmod(x, F.lit(2))


def import_plan(w: Column | str, h: Column | str, duration_ms: Column | str, fps: Column | str, longest: int = 640) -> dict[str, Column]:
    """Target size, frame rate, number of frames and bytes of an imported video."""
    w, h, ms = col(w), col(h), col(duration_ms)
    scale = F.lit(float(longest)) / F.greatest(w, h, F.lit(1))
    dst_w, dst_h = (even_up(half_up(x * scale)) for x in (w, h))
    rate = F.least(F.lit(30.0), F.greatest(F.lit(1.0), col(fps)))
    frames = F.ceil(ms / 1000.0 * rate)
    size = frames * F.floor(dst_w * dst_h * 3 / 2) + F.floor(F.lit(88200.0) * (ms / 1000.0))
    return {"dst_w": dst_w.cast("long"), "dst_h": dst_h.cast("long"), "target_fps": rate, "n_frames": frames.cast("long"), "n_bytes": size.cast("long")}


def downsample_factor(w: Column | str, h: Column | str, to_w: int = 2560, to_h: int = 1600) -> Column:
    """The least power of two that brings a picture within the target."""
    ratio = F.greatest(col(w) / to_w, col(h) / to_h)
    out = F.lit(1 << 15)
    for k in range(14, -1, -1):
        out = F.when(ratio <= 1 << k, 1 << k).otherwise(out)
    return out.cast("long")


def zoom_crop(w: Column | str, h: Column | str, most: float, ratio: Column) -> dict[str, Column]:
    """The centred rectangle that a digital zoom of most**ratio leaves."""
    zoom = F.pow(F.lit(most), ratio)
    half_w, half_h = (F.floor(F.floor(col(x) / zoom) / 2) for x in (w, h))
    cx, cy = F.floor(col(w) / 2), F.floor(col(h) / 2)
    out = {"x0": cx - half_w, "y0": cy - half_h, "x1": cx + half_w, "y1": cy + half_h}
    return {k: v.cast("long") for k, v in out.items()}


def tile_index(x: Column, y: Column, view_w: int, view_h: int, n: int) -> Column:
    """Which of n tiles of a square grid a touch selects; beyond them, the nearest of the first and last."""
    grid = 1
    while grid * grid < n:
        grid += 1
    at = F.floor(y / (view_h // grid)) * grid + F.floor(x / (view_w // grid))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("long")


def item_id(ts_ms: Column | str) -> Column:
    """The UTC time as an id that sorts by time."""
    return F.date_format(F.timestamp_millis(col(ts_ms)), "yyyy-MM-dd-HH-mm-ss-SSS")


def megabytes(size: Column | str) -> Column:
    """Whole megabytes from ten up, else one decimal; rounded down."""
    tenths = F.floor(col(size) / 100_000).cast("long")
    whole = F.floor(tenths / 10).cast("string")
    return F.when(tenths >= 100, whole).otherwise(F.concat(whole, F.lit("."), F.pmod(tenths, F.lit(10)).cast("string")))


def pcm_byte_offset(ms: Column | str, rate: int = 44_100) -> Column:
    """Where in 16-bit mono samples a time lies."""
    return (F.floor(col(ms) * rate / 1000) * 2).cast("long")


def ebml_length_bytes(n: Column | str, compat: bool = False) -> Column:
    """How many bytes a self-delimiting length takes. Minimal by default; compat switches at half of each range."""
    n = col(n)
    out = F.lit(8)
    for k in range(7, 0, -1):
        limit = 1 << (7 * k - 1) if compat else (1 << 7 * k) - 1
        out = F.when(n < limit, k).otherwise(out)
    return out.cast("int")


def _shifted(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def ebml_length(n: Column | str, compat: bool = False) -> Column:
    """The self-delimiting length as lower-case hexadecimal digits, two a byte."""
    size = ebml_length_bytes(n, compat)
    marked = col(n) + _shifted(size * 7)
    return F.lower(F.lpad(F.hex(marked), size * 2, F.lit("0")))


def ebml_length_value(digits: Column | str) -> Column:
    """The number that a self-delimiting length, as hexadecimal digits, stands for."""
    whole = F.conv(col(digits), 16, 10).cast("long")
    return whole - _shifted(F.floor(F.length(col(digits)) / 2) * 7)


def ebml_integer(n: Column | str, least: int = 1) -> Column:
    """An unsigned integer's big-endian bytes without leading zeros, as lower-case hexadecimal digits."""
    digits = F.hex(col(n))
    size = F.greatest(F.lit(least), F.ceil(F.length(digits) / 2)).cast("int")
    return F.lower(F.lpad(digits, size * 2, F.lit("0")))
