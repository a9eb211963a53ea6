"""Effects by name: parameters are checked and kernels made once, on the driver; frames run through them in tasks.

A kernel takes the planes of one frame and its time and returns red, green and blue. Several effects run in one pass over the
frames, so each frame is read and sent to Python once. Memory is bound by a frame; there is no shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators import planes as K
from .colours import scheme

#: (planes, milliseconds) -> (3, height, width)
Kernel = Callable[[K.Planes, int], np.ndarray]
#: Frames larger than this are made smaller before they are painted in oil.
OIL_LONGEST = 720


@dataclass(frozen=True)
class Effect:
    """name and params are the effect's metadata: effect(name, params) makes it again."""

    name: str
    params: Mapping
    kernel: Kernel

    def metadata(self) -> dict[str, str]:
        return {"name": self.name, "params": json.dumps(self.params, sort_keys=True)}


def _edge(params: Mapping) -> Kernel:
    paint = scheme(params).paint
    return lambda planes, ms: paint(K.edge(planes[0]), ms)


def _edge_luminance(params: Mapping) -> Kernel:
    return lambda planes, ms: K.edge_luminance(planes)


def _solid(params: Mapping) -> Kernel:
    paint = scheme(params).paint
    return lambda planes, ms: paint(planes[0], ms)


def _convolve(params: Mapping) -> Kernel:
    taps, paint = tuple(float(c) for c in params["coefficients"]), scheme(params).paint
    if len(taps) != 9:
        raise ValueError(f"a 3 x 3 kernel has nine coefficients, not {len(taps)}")
    return lambda planes, ms: paint(K.convolve3x3(planes[0], taps), ms)


def _permute(params: Mapping) -> Kernel:
    order, flip = tuple(str(params[c]).upper() for c in ("red", "green", "blue")), bool(params.get("flipUV", False))
    missing = [s for s in order if s not in K.CHANNELS]
    if missing:
        raise ValueError(f"unknown channel source {missing[0]!r}")
    return lambda planes, ms: K.permute(planes, order, flip)


def _cartoon(params: Mapping) -> Kernel:
    radius = int(params.get("blurRadius", 4))
    return lambda planes, ms: K.cartoon(planes, radius)


def _glyphs(params: Mapping) -> Kernel:
    colours = params.get("colors", {})
    text, back = (tuple(int(c) for c in colours.get(k, d))[:3] for k, d in (("text", (255, 255, 255)), ("background", (0, 0, 0))))
    mode = str(params.get("colorMode", "fixed")).lower()
    mode = mode if mode in ("fixed", "primary", "full") else "fixed"
    chars, columns, least = params.get("pixelChars") or " .o8", int(params.get("numColumns", 120)), int(params.get("minCharWidth", 10))
    return lambda planes, ms: K.glyph_frame(planes, columns, least, len(chars), mode, text, back)


def _rain(params: Mapping) -> Kernel:
    text = int(params.get("textColor", 0x00FF00))
    rgb, edges, columns, least = (text >> 16 & 255, text >> 8 & 255, text & 255), bool(params.get("edges", False)), int(params.get("numColumns", 120)), int(params.get("minCharWidth", 10))
    return lambda planes, ms: K.rain_frame(planes, columns, least, rgb, edges)


def _oil(params: Mapping) -> Kernel:
    how = int(params.get("brushSize", 8)), int(params.get("levels", 32)), float(params.get("contrastSensitivity", 2.0))

    def kernel(planes: K.Planes, ms: int) -> np.ndarray:
        height, width = planes[0].shape
        longest = max(width, height)
        if longest > OIL_LONGEST:
            planes = K.resized(planes, *(int(x * OIL_LONGEST / longest + 0.5) for x in (width, height)))
        return K.oil_mode(planes, *how)

    return kernel


def _glass(params: Mapping) -> Kernel:
    sections, thick, variation = int(params.get("sectionsPerRow", 64)), float(params.get("edgeThickness", 0.002)), float(params.get("colorVariation", 0.1))
    edge, least = tuple(int(c) for c in params.get("edgeColor", (0, 0, 0)))[-3:], int(params.get("minSegment", 16))

    def kernel(planes: K.Planes, ms: int) -> np.ndarray:
        width = planes[0].shape[1]
        return K.stained_glass(planes, max(least, width // sections), max(1, int(thick * width + 0.5)), edge, int(255 * variation))

    return kernel


#: The names of effects.
EFFECTS: dict[str, Callable[[Mapping], Kernel]] = {
    "edge": _edge,
    "edge_luminance": _edge_luminance,
    "solid_color": _solid,
    "convolve3x3": _convolve,
    "permute_color": _permute,
    "cartoon": _cartoon,
    "ascii": _glyphs,
    "matrix": _rain,
    "oil_painting": _oil,
    "stained_glass": _glass,
}


def effect(name: str, params: Mapping | str | None = None) -> Effect:
    """The effect of a name and its parameters (a mapping or JSON); ValueError or KeyError if there is none or a parameter is missing."""
    if name not in EFFECTS:
        raise ValueError(f"unknown effect {name!r}; there are {', '.join(EFFECTS)}")
    own = json.loads(params) if isinstance(params, str) else dict(params or {})
    return Effect(name, own, EFFECTS[name](own))


def effect_or_default(name: str, params: Mapping | str | None = None) -> Effect:
    """effect(), or edges by luminance if the name or a parameter is no good, as for preferences that can't be read any more."""
    try:
        return effect(name, params)
    except (ValueError, KeyError, TypeError, IndexError):
        return effect("edge_luminance")


def combination(effects: Sequence[Effect], tile: tuple[int, int], portrait: bool = False, x_flipped: bool = False, y_flipped: bool = False) -> Kernel:
    """All effects in tiles of a square grid, each run on the frame at a tile's size; the grid is seen in order after the frame's turn and flips."""
    n = math.ceil(math.sqrt(len(effects)))
    width, height = tile

    def kernel(planes: K.Planes, ms: int) -> np.ndarray:
        small, out = K.resized(planes, width, height), np.zeros((3, n * height, n * width), np.int64)
        for k, one in enumerate(effects):
            a, b = k % n, k // n
            x, y = (b, n - 1 - a) if portrait else (a, b)
            x, y = n - 1 - x if x_flipped else x, n - 1 - y if y_flipped else y
            painted = one.kernel(small, ms)[:, :height, :width]
            out[:, y * height : y * height + painted.shape[1], x * width : x * width + painted.shape[2]] = painted
        return out

    return kernel


def apply_effects(frames: DataFrame, kernels: Mapping[int, Kernel]) -> DataFrame:
    """(effect, frame_id, width, height, rgb): a row for each frame and kernel, its number first. frames: (frame_id, ms, width, height, yp, up, vp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, ms, width, height, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                planes = K.whole_planes(width, height, *parts)
                made = [np.moveaxis(kernel(planes, ms), 0, 2).astype(np.uint8) for kernel in kernels.values()]
                columns = [pa.array(list(kernels), pa.int32()), pa.array([frame] * len(made), pa.int64()), *(pa.array([m.shape[k] for m in made], pa.int32()) for k in (1, 0)), pa.array([m.tobytes() for m in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["effect", "frame_id", "width", "height", "rgb"])

    return frames.select("frame_id", "ms", "width", "height", "yp", "up", "vp").mapInArrow(run, "effect int, frame_id bigint, width int, height int, rgb binary")


def effect_pixels(frames: DataFrame, kernels: Mapping[int, Kernel]) -> DataFrame:
    """(effect, frame_id, x, y, r, g, b) of apply_effects()'s pictures, by one worker for each task: it holds a batch of planes and one picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                frame, ms, width, height, *parts = (x.as_py() for x in row)
                planes = K.whole_planes(width, height, *parts)
                for number, kernel in kernels.items():
                    made = kernel(planes, ms).astype(np.uint8).astype(np.int64)
                    at = np.arange(made[0].size)
                    columns = [np.full(len(at), number), np.full(len(at), frame), at % made.shape[2], at // made.shape[2], *(c.ravel() for c in made)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["effect", "frame_id", "x", "y", "r", "g", "b"])

    return frames.select("frame_id", "ms", "width", "height", "yp", "up", "vp").mapInArrow(run, "effect bigint, frame_id bigint, x bigint, y bigint, r bigint, g bigint, b bigint")
