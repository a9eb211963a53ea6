"""Queries of plane-form kernels; the SQL of pixel form checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.planes import KERNELS, apply, rgb_pixels
from ..sources import frames as R
from . import raster

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = {
    "plane_edge_luminance": raster.ORACLES["edge_luminance"],
    "plane_cartoon": raster.CARTOON_SQL,
    "plane_oil_mode": f"SELECT frame_id, x, y, colour // 65536 AS r, colour // 256 % 256 AS g, colour % 256 AS b FROM ({raster.OIL_SQL})",
    "plane_stained_glass": raster.GLASS_SQL,
}
for _name, _kernel in KERNELS.items():
    QUERIES[f"plane_{_name}"] = lambda spark, sf, kernel=_kernel: rgb_pixels(apply(R.to_planes(R.event_pixels(spark, sf), R.EVENT_W, R.EVENT_H), kernel))
