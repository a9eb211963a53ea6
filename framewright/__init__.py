"""Raster, frame-stream and media-catalog analytics on Spark."""
