"""All queries of the raster and media operators, and the SQL that checks them."""

from __future__ import annotations

from .plans import effects, files, glyph, kernels, media, raster, streams

QUERIES: dict = raster.QUERIES | glyph.QUERIES | media.QUERIES | kernels.QUERIES | effects.QUERIES | streams.QUERIES | files.QUERIES
ORACLES: dict[str, str] = raster.ORACLES | glyph.ORACLES | media.ORACLES | kernels.ORACLES | effects.ORACLES | streams.ORACLES | files.ORACLES
