"""From arriving frames to files: an effect over the latest frame of each camera, as photos and as appended raw video, each file once.

A micro-batch goes to both sinks under names that its number and its frames give. If the job is stopped between the two, or between a sink and the commit of the
batch, the batch runs again with the same frames and writes the same names; the sinks put a file there whole, in place of what is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.planes import Kernel, apply
from ..sinks import files as X
from ..sinks.commit import append_files, write_files


def video_name(video, batch: int):
    """Segments of a video sort by batch; laid one after another they are the video."""
    return F.format_string("video/%d/%08d.raw", video, F.lit(batch))


def record(kernel: Kernel, folder: str, between: Callable[[int], None] = lambda batch: None) -> Callable[[DataFrame, int], None]:
    """The work of a micro-batch of frames (video, frame_id, width, height, yp, up, vp): photos/<frame>.png of the effect, and the raw planes as a segment of
    each video. between: called after the first sink (tests stop the job there)."""

    def run(batch: DataFrame, number: int) -> None:
        photos = X.png_files(apply(batch, kernel))
        write_files(photos.select(F.format_string("photos/%012d.png", "frame_id").alias("name"), "content"), folder)
        between(number)
        raw = batch.select(video_name(F.col("video"), number).alias("name"), F.col("frame_id").alias("place"), F.concat("yp", "up", "vp").alias("content"))
        append_files(raw, folder)

    return run


def recorder(frames: DataFrame, kernel: Kernel, folder: str, checkpoint: str, between: Callable[[int], None] = lambda batch: None) -> DataStreamWriter:
    """The stream's writer, to be started: restartable from its checkpoint."""
    return frames.writeStream.foreachBatch(record(kernel, folder, between)).option("checkpointLocation", checkpoint)
