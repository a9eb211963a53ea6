"""Column expressions for pixel values: colour spaces, colour maps, quantisers, packing.

Channels are integers from 0 to 255. All but the ``trunc`` and ``round`` conversions are integer arithmetic, so they give the same
values in any engine. Everything here stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rgb = tuple[Column, Column, Column]

# Coefficients of v in red, v and u in green, u in blue.
FIXED_POINT = {"fixed": (351, 179, 86, 443), "glyph_fixed": (359, 183, 88, 454)}
REAL = {"round": (1.370705, 0.698001, 0.337633, 1.732446), "trunc": (1.370705, 0.698001, 0.337633, 1.732446), "glyph_round": (1.402, 0.714136, 0.344136, 1.772)}
VARIANTS = (*FIXED_POINT, *REAL)


def col(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column) -> Column:
    """Rounds halves toward positive infinity, unlike round()."""
    return F.floor(x + F.lit(0.5))


def divide(x: Column, by: Column | int) -> Column:
    """Integer division of numbers that aren't negative."""
    return F.floor(x / by).cast("long")


def yuv_to_rgb(y: Column | str, u: Column | str, v: Column | str, variant: str = "fixed") -> Rgb:
    """Red, green and blue of a YUV pixel; the variants differ by a few levels in how they round."""
    y, u, v = col(y), col(u) - 128, col(v) - 128
    if variant in FIXED_POINT:
        rv, gv, gu, bu = FIXED_POINT[variant]
        out = y + F.shiftright(v * rv, 8), y - F.shiftright(v * gv + u * gu, 8), y + F.shiftright(u * bu, 8)
        return tuple(clamp(c).cast("int") for c in out)
    if variant not in REAL:
        raise ValueError(f"unknown variant {variant!r}; there are {', '.join(VARIANTS)}")
    rv, gv, gu, bu = REAL[variant]
    y, u, v = (c.cast("double") for c in (y, u, v))
    out = y + F.lit(rv) * v, y - F.lit(gv) * v - F.lit(gu) * u, y + F.lit(bu) * u
    if variant != "trunc":
        out = tuple(half_up(c) for c in out)
    return tuple(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c.cast("double")))).cast("int") for c in out)


def rgb_to_yuv(r: Column | str, g: Column | str, b: Column | str) -> Rgb:
    r, g, b = (col(c).cast("double") for c in (r, g, b))
    y = F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b
    out = y, (b - y) * 0.565 + 128, (r - y) * 0.713 + 128
    return tuple(clamp(half_up(c)).cast("int") for c in out)


def colour_map(i: Column | str, low: tuple[int, int, int], high: tuple[int, int, int]) -> Rgb:
    """The 256-step map from one colour to another, as a closed form."""
    return tuple(F.floor((F.lit(2 * 255 * a + 255) + col(i) * (2 * (b - a))) / 510).cast("int") for a, b in zip(low, high))


def alpha_map(i: Column | str, colour: tuple[int, int, int]) -> Column:
    """The colour, opaque at 0 and clear at 255, as packed ARGB."""
    return pack_argb(255 - col(i), *[F.lit(c) for c in colour])


def pack_argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    a, r, g, b = (c.cast("long") for c in (a, r, g, b))
    return F.shiftleft(a, 24) + F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def unpack_argb(argb: Column | str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.shiftright(col(argb), k).bitwiseAND(F.lit(255)).cast("int") for k in (24, 16, 8, 0))


def source_over(fg: Rgb, alpha: Column, bg: Rgb) -> Rgb:
    """Integer blend of fg over an opaque bg, rounded to the nearest level."""
    return tuple(F.floor((f * alpha + b * (255 - alpha) + 127) / 255).cast("int") for f, b in zip(fg, bg))


def permute(r: Column, g: Column, b: Column, sources: tuple[str, str, str]) -> Rgb:
    """Each output channel from MIN, RED, GREEN, BLUE or MAX."""
    of = {"MIN": F.lit(0), "RED": r, "GREEN": g, "BLUE": b, "MAX": F.lit(255)}
    missing = [s for s in sources if s.upper() not in of]
    if missing:
        raise ValueError(f"unknown channel source {missing[0]!r}")
    return tuple(of[s.upper()] for s in sources)


def flip_chroma(u: Column | str) -> Column:
    return F.pmod(-col(u), F.lit(256)).cast("int")


def quantise4(c: Column) -> Column:
    """The nearest of the levels 0, 85, 170, 255."""
    return (F.floor((c * 2 + 85) / 170) * 85).cast("int")


def quantise(c: Column, levels: int) -> Column:
    step = 256 // levels
    return (F.floor(c / step) * step).cast("int")


def char_index(luma: Column | str, n: int, scale: int = 255) -> Column:
    """Which of n characters, dark to bright; scale 255 is that of cells, 256 that of text exports."""
    return F.least(F.lit(n - 1), F.floor(col(luma) * n / scale)).cast("int")


def primary(r: Column, g: Column, b: Column) -> Rgb:
    """Channels of at least 7/8 of the largest become 255, the others 0."""
    limit = F.floor(F.greatest(r, g, b) * 7 / 8)
    return tuple(F.when(c >= limit, 255).otherwise(0) for c in (r, g, b))


def css_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(pack_argb(F.lit(0), r, g, b)), 6, "0")))


def edge_multiplier(width: int) -> int:
    """How much edges are amplified in a frame of this width."""
    return min(4, max(2, int(width / 480 + 0.5)))
