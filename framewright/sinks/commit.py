"""A sink of files with a commit: rows (name, content) become files of a folder when all tasks have ended well, or none of them does.

Tasks write parts into a hidden folder of the job; the commit moves each to its name in one step, and an abort takes the hidden folder away. What a lost or
failed task has left there goes with it. Rows of one name that follow each other in a task are one file, so a video can be appended frame by frame while a
task holds one frame. A stream commits each micro-batch; a batch that runs again gives the same names, and so the same files once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from ..session import register
from ..sources.storage import file_system


@dataclass
class Parts(WriterCommitMessage):
    """(part, name, length) of the files that a task has written."""

    files: list[tuple[str, str, int]]


class FrameFiles(DataSource):
    """Options: path, the folder. Rows: name string, content binary."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BatchWriter(self.options["path"], schema.fieldNames())

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return StreamWriter(self.options["path"], schema.fieldNames())


class _Folder:
    def __init__(self, path: str, columns: list[str]):
        if columns[:2] != ["name", "content"]:
            raise ValueError("rows of files are (name, content)")
        self.path, self.job = path.rstrip("/"), f".parts-{uuid.uuid4().hex}"
        system, folder = file_system(self.path)
        system.create_dir(f"{folder}/{self.job}")

    def write_parts(self, batches: Iterator[pa.RecordBatch]) -> Parts:
        system, folder = file_system(self.path)
        task, files, out = f"{folder}/{self.job}/{uuid.uuid4().hex}", [], None
        system.create_dir(task, recursive=False)  # a task that goes on after an abort finds no folder of the job
        try:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if name is None or not name.strip("/") or ".." in name.split("/"):
                        raise ValueError(f"{name!r} is no name of a file")
                    if not files or files[-1][1] != name:
                        if out:
                            out.close()
                        files.append((f"{task}/{len(files)}", name, 0))
                        out = system.open_output_stream(files[-1][0])
                    if content.is_valid:
                        out.write(content.as_buffer())
                        files[-1] = (*files[-1][:2], files[-1][2] + len(content.as_buffer()))
        finally:
            if out:
                out.close()
        return Parts(files)

    def move(self, messages: list[Parts | None]) -> None:
        system, folder = file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name.strip("/") for _, name, _ in files]
        if len({*names}) < len(names):
            self.drop()
            raise ValueError("rows of one file lie apart: give each name to one task, in order")
        for made in sorted({f"{folder}/{n}".rpartition("/")[0] for n in names}):
            system.create_dir(made)
        for (part, _, _), name in zip(files, names):
            to = f"{folder}/{name}"
            if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(to).type != fs.FileType.NotFound:
                system.delete_file(to)
            system.move(part, to)
        self.drop()

    def drop(self) -> None:
        """Takes the parts away; while tasks of an aborted job still write, they may add to a folder that is being deleted."""
        system, folder = file_system(self.path)
        for wait in (0, 0.1, 0.5, 2):
            time.sleep(wait)
            if system.get_file_info(f"{folder}/{self.job}").type == fs.FileType.NotFound:
                return
            try:
                system.delete_dir(f"{folder}/{self.job}")
            except OSError:
                if wait == 2:
                    raise


class BatchWriter(_Folder, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        return self.write_parts(iterator)

    def commit(self, messages: list[Parts | None]) -> None:
        self.move(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        self.drop()


class StreamWriter(_Folder, DataSourceStreamArrowWriter):
    def drop(self) -> None:
        """Takes a batch's parts away; the folder stays for the next one."""
        system, folder = file_system(self.path)
        system.delete_dir_contents(f"{folder}/{self.job}", missing_dir_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        return self.write_parts(iterator)

    def commit(self, messages: list[Parts | None], batchId: int) -> None:
        self.move(messages)

    def abort(self, messages: list[Parts | None], batchId: int) -> None:
        self.drop()


def write_files(files: DataFrame, folder: str) -> None:
    """Writes rows (name, content), each name once, as files of the folder: all of them or none."""
    register(files.sparkSession, FrameFiles)
    files.select("name", "content").write.format("frame_files").mode("append").save(folder)


def append_files(parts: DataFrame, folder: str) -> None:
    """Writes rows (name, place, content): the contents of a name one after another, by place, in one file. A file is one task's work, which holds one row of it."""
    ordered = parts.select("name", "place", "content").repartition("name").sortWithinPartitions("name", "place")
    write_files(ordered, folder)


def stream_files(files: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """The writer of a stream of rows (name, content), to be started: a micro-batch's files appear together with its commit."""
    register(files.sparkSession, FrameFiles)
    own = files.select(F.col("name"), F.col("content"))
    return own.writeStream.format("frame_files").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
