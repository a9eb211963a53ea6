"""Files as Python workers reach them: by a folder's address, through Arrow's file systems (local, HDFS, S3, GCS, and what else Arrow knows)."""

from __future__ import annotations

import re

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path there. An address without a scheme is a local one; ``file:/x`` and ``file:///x`` are the same."""
    if not re.match(r"\w[\w+.-]*:/", path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def files_in(path: str) -> list[fs.FileInfo]:
    """The files at an address, in a folder and below it, by path; names that begin with a dot or an underscore are hidden, as are folders of such."""
    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        return []
    shown = lambda x: not any(part[:1] in "._" for part in x.path[len(at) :].strip("/").split("/"))
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((x for x in found if x.type == fs.FileType.File and shown(x)), key=lambda x: x.path)
