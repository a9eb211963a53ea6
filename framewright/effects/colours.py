"""Colour schemes of effects: how a value from 0 to 255 at each pixel becomes a colour, from open parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np

from ..operators.geometry import GridGradient

Rgb = tuple[int, int, int]
#: (width, height, milliseconds) -> the three channels of a background.
Background = Callable[[int, int, int], np.ndarray]


def colour(params: Mapping, *keys: str) -> Rgb:
    """The colour under the first of the keys that is there; ValueError if none is."""
    for key in keys:
        if key in params:
            r, g, b = params[key][:3]
            return int(r), int(g), int(b)
    raise ValueError(f"no colour {' or '.join(keys)}")


def _between(share: np.ndarray, first: Rgb, last: Rgb) -> np.ndarray:
    turn = np.mod(share, 2.0)
    share = np.where(turn > 1, 2.0 - turn, turn)
    return np.stack([np.floor(share * float(b - a) + float(a) + 0.5).astype(np.int64) for a, b in zip(first, last)])


def linear(first: Rgb, last: Rgb) -> Background:
    """From one corner to the other."""

    def draw(width: int, height: int, ms: int) -> np.ndarray:
        y, x = np.mgrid[:height, :width]
        return _between((x * width + y * height).astype(float) / float(width * width + height * height), first, last)

    return draw


def radial(centre: Rgb, outer: Rgb) -> Background:
    """From the middle outward, mirrored beyond half of the larger side."""

    def draw(width: int, height: int, ms: int) -> np.ndarray:
        y, x = np.mgrid[:height, :width]
        dx, dy = x * 2 - width, y * 2 - height
        return _between(np.sqrt((dx * dx + dy * dy).astype(float)) / float(max(width, height)), centre, outer)

    return draw


def grid(g: GridGradient) -> Background:
    """The animated gradient, as geometry.grid_background() has it in columns."""

    def draw(width: int, height: int, ms: int) -> np.ndarray:
        phase = [ms * speed // 1000 % (n * 1000) * size * 2 + 1000 for speed, n, size in ((g.speed_x, len(g.cells[0]), g.width), (g.speed_y, len(g.cells), g.height))]
        y, x = np.mgrid[:height, :width]
        bx = (phase[0] // 2000 + x * int(g.size_x * g.per_cell) // width) % g.width
        by = (phase[1] // 2000 + y * int(g.size_y * g.per_cell) // height) % g.height
        n, fx, fy = max(1, g.per_cell - 1), bx % g.per_cell, by % g.per_cell
        corners = np.array(g.cells, np.int64)[by // g.per_cell, bx // g.per_cell]
        out = []
        for k in range(3):
            top, bottom = (corners[..., k + j] * (n - fx) + corners[..., k + j + 3] * fx for j in (0, 6))
            out.append(((top * (n - fy) + bottom * fy) * 2 + n * n) // (2 * n * n))
        return np.stack(out)

    return draw


@dataclass(frozen=True)
class Scheme:
    """A map from low to high, or, with a background, low over it, opaque at 0 and clear at 255."""

    low: Rgb = (0, 0, 0)
    high: Rgb = (255, 255, 255)
    background: Background | None = None

    def paint(self, value: np.ndarray, ms: int) -> np.ndarray:
        if self.background is None:
            return np.stack([(2 * 255 * a + 255 + value * (2 * (b - a))) // 510 for a, b in zip(self.low, self.high)])
        behind = self.background(value.shape[1], value.shape[0], ms)
        return np.stack([(a * (255 - value) + behind[k] * value + 127) // 255 for k, a in enumerate(self.low)])


def scheme(params: Mapping) -> Scheme:
    """The scheme under ``colors``, or of the parameters themselves where that is missing; black to white if its type is none of the four.

    The low and the high colour have older names (minEdgeColor, maxEdgeColor), which a grid gradient doesn't know.
    """
    own = params.get("colors", params)
    kind = own.get("type")
    if kind == "fixed":
        return Scheme(colour(own, "minColor", "minEdgeColor"), colour(own, "maxColor", "maxEdgeColor"))
    if kind == "linear_gradient":
        return Scheme(colour(own, "minColor", "minEdgeColor"), background=linear(colour(own, "gradientStartColor"), colour(own, "gradientEndColor")))
    if kind == "radial_gradient":
        return Scheme(colour(own, "minColor", "minEdgeColor"), background=radial(colour(own, "centerColor"), colour(own, "outerColor")))
    if kind == "grid_gradient":
        cells = tuple(tuple(tuple(int(c) for c in cell) for cell in row) for row in own["grid"])
        moves = int(own.get("speedX", 0)), int(own.get("speedY", 0)), float(own.get("sizeX", 1)), float(own.get("sizeY", 1)), int(own.get("pixelsPerCell", 80))
        return Scheme(colour(own, "minColor"), background=grid(GridGradient(cells, *moves)))
    return Scheme()
