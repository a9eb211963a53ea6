"""The presets: effects with parameters, in the order in which a grid shows them."""

from __future__ import annotations

from collections.abc import Mapping

from .registry import Effect, effect

# Colours, gradients, characters and kernels of the presets.
BLACK, WHITE, RED, GREEN, BLUE = (0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255)
CYAN, YELLOW, ORANGE, MAGENTA = (0, 255, 255), (255, 255, 0), (255, 128, 0), (255, 0, 255)
RAINBOW = ((128, 0, 0), (96, 96, 0), (0, 128, 0), (0, 96, 96), (0, 0, 128), (96, 0, 96))
EDGE_MAPS = ((BLACK, WHITE), (BLACK, GREEN), (BLACK, RED), (BLACK, CYAN), (BLACK, YELLOW), (WHITE, BLACK), (WHITE, (0, 160, 0)), (WHITE, RED), (WHITE, BLUE))
EMBOSS = (8, 4, 0, 4, 1, -4, 0, -4, -8)
OIL = {"subtle": (4, 48, 1.5), "standard": (8, 32, 2.0), "heavy": (12, 20, 3.0), "impressionist": (15, 16, 2.5)}
GLASS = {"default": (64, 0.002, BLACK, 0.1), "large": (32, 0.003, (64, 64, 64), 0.15), "fine": (128, 0.001, BLACK, 0.05)}
CHARS = {"pixelChars.BLACK_ON_WHITE": "#o:..  ", "pixelChars.WHITE_ON_BLACK": " .:oO8#", "pixelChars.ANSI_COLOR": " .:oO8#", "pixelChars.FULL_COLOR": "O8#"}
CUSTOM = {"custom1": "EDGE", "custom2": "SOLID"}
CUSTOM_COLOURS = {"background": BLACK, "topLeft": RED, "topRight": BLUE, "bottomLeft": GREEN, "bottomRight": WHITE}
COLUMN_CHOICES = (60, 80, 100, 120, 150, 200)
NORMAL_CELL, GRID_CELL = 80, 20


def fixed(low: tuple, high: tuple) -> dict:
    return {"colors": {"type": "fixed", "minColor": low, "maxColor": high}}


def gradient(low: tuple, cells: tuple, per_cell: int, **moves) -> dict:
    """cells: rows of cells of four corner colours."""
    flat = [[[c for corner in cell for c in corner] for cell in row] for row in cells]
    return {"colors": {"type": "grid_gradient", "minColor": low, "grid": flat, **moves, "pixelsPerCell": per_cell}}


def oil(name: str = "standard") -> Effect:
    brush, levels, contrast = OIL[name]
    return effect("oil_painting", {"brushSize": brush, "levels": levels, "contrastSensitivity": contrast})


def glass(name: str = "default") -> Effect:
    sections, thickness, edge, variation = GLASS[name]
    return effect("stained_glass", {"sectionsPerRow": sections, "edgeThickness": thickness, "edgeColor": edge, "colorVariation": variation})


def columns(prefs: Mapping) -> int:
    """The number of columns of characters that is preferred: one of COLUMN_CHOICES, else 120."""
    n = prefs.get("numColumns", 120)
    return n if n in COLUMN_CHOICES else 120


def custom(name: str, prefs: Mapping, per_cell: int) -> Effect:
    """A custom scheme: a gradient between four corners behind edges or the picture; what the preference lacks is the default's."""
    own = prefs.get(name, {})
    own = own if isinstance(own, Mapping) else {}
    kind = own.get("type", CUSTOM[name])
    back, *corners = (tuple(own.get(k, d)) for k, d in CUSTOM_COLOURS.items())
    # the scheme stands in the parameters themselves, without ``colors``
    return effect("solid_color" if kind == "SOLID" else "edge", gradient(back, ((tuple(corners),),), per_cell)["colors"])


def _made(prefs: Mapping, cell: int) -> list:
    across = [((a, a, b, b),) for a, b in zip(RAINBOW, (*RAINBOW[1:], RAINBOW[0]))]
    beside = lambda a, b: (a, b, a, b)
    permuted = lambda r, g, b, flip=False: ("permute_color", {"red": r, "green": g, "blue": b, "flipUV": flip})
    ascii_ = lambda mode, key, **more: ("ascii", {"colorMode": mode, **more, "pixelChars": prefs.get(key, CHARS[key]), "numColumns": columns(prefs), "prefId": key, **least})
    rain = lambda edges: ("matrix", {"numColumns": columns(prefs), "textColor": prefs.get("matrixTextColor", 0x00FF00), "edges": edges, **least})
    least = {"minCharWidth": prefs["minCharWidth"]} if "minCharWidth" in prefs else {}
    inks = lambda text, back: {"colors": {"text": text, "background": back}}
    return [
        ("edge_luminance", {}),
        *(("edge", fixed(low, high)) for low, high in EDGE_MAPS),
        ("edge", gradient(WHITE, across, cell, sizeY=3.0, speedY=500)),
        ("edge", gradient((255, 255, 192), (((RED, (0, 192, 0), BLUE, BLACK),),), cell)),
        ("edge", gradient((255, 182, 193), ((((0, 128, 0), (128, 0, 0), (0, 128, 128), (128, 0, 128)),),), cell)),
        ("edge", {"colors": {"type": "linear_gradient", "minColor": BLACK, "gradientStartColor": GREEN, "gradientEndColor": BLUE}}),
        ("edge", {"colors": {"type": "radial_gradient", "minColor": (25, 25, 112), "centerColor": YELLOW, "outerColor": (255, 70, 0)}}),
        ("edge", gradient(BLACK, ((beside(RED, GREEN), beside(GREEN, RED)),), cell, speedX=250)),
        ("edge", gradient(BLACK, (((RED, GREEN, BLUE, WHITE), (GREEN, RED, WHITE, BLUE)), ((BLUE, WHITE, RED, GREEN), (WHITE, BLUE, GREEN, RED))), cell, sizeX=0.5, sizeY=0.5, speedX=300, speedY=200)),
        ("solid_color", gradient(BLACK, (((WHITE, RED, GREEN, BLUE),),), cell)),
        permuted("RED", "GREEN", "BLUE"),
        ("solid_color", fixed(WHITE, BLACK)),
        permuted("BLUE", "RED", "GREEN"),
        permuted("GREEN", "BLUE", "RED"),
        permuted("RED", "GREEN", "BLUE", True),
        ("solid_color", gradient(CYAN, ((beside(MAGENTA, RED), beside(RED, ORANGE), beside(ORANGE, RED), beside(RED, MAGENTA)),), cell, speedX=500)),
        ascii_("fixed", "pixelChars.BLACK_ON_WHITE", **inks(BLACK, WHITE)),
        ascii_("fixed", "pixelChars.WHITE_ON_BLACK", **inks(WHITE, BLACK)),
        ascii_("primary", "pixelChars.ANSI_COLOR"),
        ascii_("full", "pixelChars.FULL_COLOR"),
        rain(True),
        rain(False),
        ("cartoon", {}),
        ("convolve3x3", {"coefficients": EMBOSS, **fixed(BLACK, WHITE)}),
        oil(),
        glass(),
        custom("custom1", prefs, cell),
        custom("custom2", prefs, cell),
    ]


PRESETS = len(_made({}, NORMAL_CELL))


def presets(prefs: Mapping | None = None, in_grid: bool = False) -> list[Effect]:
    """All presets with a user's preferences; gradients have smaller cells where many are shown in a grid."""
    return [x if isinstance(x, Effect) else effect(*x) for x in _made(prefs or {}, GRID_CELL if in_grid else NORMAL_CELL)]


def preset(number: int, prefs: Mapping | None = None, in_grid: bool = False) -> Effect:
    return presets(prefs, in_grid)[number]
