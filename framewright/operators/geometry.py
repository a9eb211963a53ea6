"""Where pixels go: orientation, fit into a target, tiles of a grid; and backgrounds, which are closed forms of place and time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import Rgb, half_up


def oriented(x: Column, y: Column, width: int, height: int, x_flipped: Column, y_flipped: Column, portrait: Column) -> tuple[Column, Column]:
    """Where a pixel is seen: a portrait frame turns clockwise by a quarter, and its flips then swap."""
    px, py = F.when(portrait, height - 1 - y).otherwise(x), F.when(portrait, x).otherwise(y)
    w, h = F.when(portrait, height).otherwise(width), F.when(portrait, width).otherwise(height)
    flip_h, flip_v = F.when(portrait, y_flipped).otherwise(x_flipped), F.when(portrait, x_flipped).otherwise(y_flipped)
    return F.when(flip_h, w - 1 - px).otherwise(px).cast("int"), F.when(flip_v, h - 1 - py).otherwise(py).cast("int")


def letterbox_columns(w: Column, h: Column, to_w: int, to_h: int) -> tuple[Column, Column, Column, Column]:
    """x, y, width, height of a frame that is fitted into the middle of a target."""
    wide = h * to_w <= w * to_h
    new_w = F.when(wide, to_w).otherwise(F.floor(w * to_h / h))
    new_h = F.when(wide, F.floor(h * to_w / w)).otherwise(to_h)
    return tuple(c.cast("long") for c in (F.floor((to_w - new_w) / 2), F.floor((to_h - new_h) / 2), new_w, new_h))


def tile_place(i: Column, grid: int, portrait: Column, x_flipped: Column, y_flipped: Column) -> tuple[Column, Column]:
    """Column and row of the i-th tile, so that the grid is seen in order after the frame's own turn and flips."""
    a, b = F.pmod(i, F.lit(grid)), F.floor(i / grid)
    x, y = F.when(portrait, b).otherwise(a), F.when(portrait, grid - 1 - a).otherwise(b)
    return F.when(x_flipped, grid - 1 - x).otherwise(x).cast("int"), F.when(y_flipped, grid - 1 - y).otherwise(y).cast("int")


def tiled(px: DataFrame, tile: tuple[int, int], grid: int, portrait: bool = False, x_flipped: bool = False, y_flipped: bool = False) -> DataFrame:
    """(frame_id, x, y, …) of the whole grid from tiles (frame_id, tile, x, y, …)."""
    at = tile_place(F.col("tile"), grid, F.lit(portrait), F.lit(x_flipped), F.lit(y_flipped))
    return px.withColumns({"x": at[0] * tile[0] + F.col("x"), "y": at[1] * tile[1] + F.col("y")}).drop("tile")


@dataclass(frozen=True)
class GridGradient:
    """cells: rows of columns of the four corners' colours, top left, top right, bottom left, bottom right."""

    cells: tuple[tuple[tuple[int, ...], ...], ...]
    speed_x: int = 0
    speed_y: int = 0
    size_x: float = 1.0
    size_y: float = 1.0
    per_cell: int = 80

    @property
    def width(self) -> int:
        return len(self.cells[0]) * self.per_cell

    @property
    def height(self) -> int:
        return len(self.cells) * self.per_cell


def gradient_phase(g: GridGradient, ts_ms: Column) -> tuple[Column, Column]:
    """The place in the gradient's bitmap that is at the top left at a time.

    The bitmap moves by its whole width, not a cell's, for each cell of the window's way; so many cells move faster.
    """
    out = []
    for speed, n, size in ((g.speed_x, len(g.cells[0]), g.width), (g.speed_y, len(g.cells), g.height)):
        thousandths = F.pmod(F.floor(ts_ms * speed / 1000), F.lit(n * 1000))
        out.append(F.pmod(F.floor((thousandths * size * 2 + 1000) / 2000), F.lit(size)).cast("int"))
    return out[0], out[1]


def gradient_colour(g: GridGradient, x: Column, y: Column) -> Rgb:
    """Colour of the bitmap at a place: bilinear in each cell, from one corner pixel to the other, rounded."""
    n = max(1, g.per_cell - 1)
    cell = (F.floor(y / g.per_cell) * len(g.cells[0]) + F.floor(x / g.per_cell)).cast("int")
    fx, fy = F.pmod(x, F.lit(g.per_cell)), F.pmod(y, F.lit(g.per_cell))
    corners = F.array(*[F.array(*[F.lit(int(c)) for c in cell_]) for row in g.cells for cell_ in row])
    own = F.get(corners, cell)
    out = []
    for k in range(3):
        top = F.get(own, F.lit(k)) * (n - fx) + F.get(own, F.lit(k + 3)) * fx
        bottom = F.get(own, F.lit(k + 6)) * (n - fx) + F.get(own, F.lit(k + 9)) * fx
        out.append(F.floor(((top * (n - fy) + bottom * fy) * 2 + n * n) / (2 * n * n)).cast("int"))
    return tuple(out)


def grid_background(g: GridGradient, x: Column, y: Column, ts_ms: Column, width: int, height: int) -> Rgb:
    """The animated background at a pixel of a frame; a pixel shows the bitmap's pixel at its own share of the window."""
    dx, dy = gradient_phase(g, ts_ms)
    window = int(g.size_x * g.per_cell), int(g.size_y * g.per_cell)
    bx = F.pmod(dx + F.floor(x * window[0] / width), F.lit(g.width)).cast("int")
    by = F.pmod(dy + F.floor(y * window[1] / height), F.lit(g.height)).cast("int")
    return gradient_colour(g, bx, by)


def _mirrored(share: Column) -> Column:
    """A share beyond one runs back, and so on."""
    turn = F.pmod(share, F.lit(2.0))
    return F.when(turn > 1, 2.0 - turn).otherwise(turn)


def _between(share: Column, first: tuple[int, int, int], last: tuple[int, int, int]) -> Rgb:
    return tuple(half_up(share * F.lit(float(b - a)) + F.lit(float(a))).cast("int") for a, b in zip(first, last))


def linear_background(x: Column, y: Column, width: int, height: int, first: tuple[int, int, int], last: tuple[int, int, int]) -> Rgb:
    """From one corner to the other, by the place along the diagonal."""
    share = (x * width + y * height).cast("double") / float(width * width + height * height)
    return _between(_mirrored(share), first, last)


def radial_background(x: Column, y: Column, width: int, height: int, centre: tuple[int, int, int], outer: tuple[int, int, int]) -> Rgb:
    """From the middle outward; the colours mirror beyond half of the larger side."""
    dx, dy = x * 2 - width, y * 2 - height
    share = F.sqrt((dx * dx + dy * dy).cast("double")) / float(max(width, height))
    return _between(_mirrored(share), centre, outer)
