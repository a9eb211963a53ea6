"""EBML: elements of files as rows, by a parser that keeps a stack of open containers, and files from rows, by a writer that sizes them.

A file is one row here and is parsed by one task, as its structure is a chain; many files are parsed side by side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Ids of elements, with their kinds: m a container, u an unsigned integer, f a float, s a string, b bytes.
IDS = {
    "1a45dfa3": ("EBML", "m"), "4286": ("EBMLVersion", "u"), "42f7": ("EBMLReadVersion", "u"), "42f2": ("EBMLMaxIDLength", "u"), "42f3": ("EBMLMaxSizeLength", "u"),
    "4282": ("DocType", "s"), "4287": ("DocTypeVersion", "u"), "4285": ("DocTypeReadVersion", "u"), "18538067": ("Segment", "m"), "1549a966": ("Info", "m"),
    "2ad7b1": ("TimecodeScale", "u"), "4d80": ("MuxingApp", "s"), "5741": ("WritingApp", "s"), "4489": ("Duration", "f"), "4461": ("DateUTC", "u"), "73a4": ("SegmentUID", "b"),
    "1654ae6b": ("Tracks", "m"), "ae": ("TrackEntry", "m"), "d7": ("TrackNumber", "u"), "73c5": ("TrackUID", "u"), "83": ("TrackType", "u"), "86": ("CodecID", "s"),
    "63a2": ("CodecPrivate", "b"), "22b59c": ("Language", "s"), "e1": ("Audio", "m"), "b5": ("SamplingFrequency", "f"), "9f": ("Channels", "u"),
    "1f43b675": ("Cluster", "m"), "e7": ("Timecode", "u"), "a3": ("SimpleBlock", "b"),
}
SCHEMA = "place int, depth int, parent int, id string, offset long, size long, value binary"


def is_container(id: str) -> bool:
    """Ids of four bytes are containers, and those that are named so."""
    return len(id) >= 8 or IDS.get(id, ("", "b"))[1] == "m"


def length_bytes(n: int, compat: bool = False) -> bytes:
    """A self-delimiting length: minimal by default; compat changes to the next width at half of each range."""
    width = next((k for k in range(1, 8) if n < (1 << 7 * k - 1 if compat else (1 << 7 * k) - 1)), 8)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _vint(data: bytes, at: int, marked: bool) -> tuple[int, int]:
    """A self-delimiting number, with its mark or without, and where it ends."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no number of one to eight bytes at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    return (n if marked else n & ~(1 << 7 * width)), at + width


def _level(id: str) -> int:
    """How deep an element with an id of four bytes lies: the header and a segment at the top, others in a segment."""
    return 0 if id in ("1a45dfa3", "18538067") else 1


def elements(data: bytes) -> Iterator[tuple[int, int, int | None, str, int, int | None, bytes | None]]:
    """(place, depth, parent, id, offset, size, value) of the elements in order; value is null for containers.

    A container ends where its size says, empty ones at once. One of unknown size (all ones; its size is null here) ends before the next element with an id of four bytes that
    isn't deeper than itself, or with the container around it. What is damaged or cut off ends the file, without an error.
    """
    at, place, open_ = 0, 0, []
    while at < len(data):
        while open_ and open_[-1][1] is not None and at >= open_[-1][1]:
            open_.pop()
        offset = at
        try:
            number, at = _vint(data, at, True)
            sized = at
            size, at = _vint(data, at, False)
        except (ValueError, IndexError):
            return
        id = f"{number:x}"
        id = id if len(id) % 2 == 0 else f"0{id}"
        unknown = size == (1 << 7 * (at - sized)) - 1
        if len(id) == 8:
            while (k := next((k for k, o in enumerate(open_) if o[2] is not None and o[2] >= _level(id)), None)) is not None:
                del open_[k:]
        parent = open_[-1][0] if open_ else None
        if is_container(id):
            yield place, len(open_), parent, id, offset, None if unknown else size, None
            around = next((o[1] for o in reversed(open_) if o[1] is not None), None)
            open_.append((place, around, _level(id)) if unknown else (place, at + size, None))
        else:
            if unknown or at + size > len(data):
                return
            yield place, len(open_), parent, id, offset, size, data[at : at + size]
            at += size
        place += 1


def parse(files: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, place, depth, parent, id, offset, size, value): the elements of each file; a null file has none."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in range(batch.num_rows):
                found = list(elements(batch.column(1)[row].as_py() or b""))
                own = batch.column(0).take(pa.array([row] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], [key, *(c.split()[0] for c in SCHEMA.split(", "))])

    return files.select(key, data).mapInArrow(run, f"{key} {kind}, {SCHEMA}")


def element_ids(spark: SparkSession) -> DataFrame:
    """(id, name, kind): the dimension of known elements."""
    return spark.createDataFrame([(i, *x) for i, x in IDS.items()], "id string, name string, kind string")


def element(id: str, value: bytes | list[bytes], compat: bool = False) -> bytes:
    """The bytes of one element; a container's value is a list of elements, whose size is known once they are written."""
    body = b"".join(value) if isinstance(value, list) else value
    return bytes.fromhex(id) + length_bytes(len(body), compat) + body


def integer(n: int, least: int = 1) -> bytes:
    return n.to_bytes(max(least, (n.bit_length() + 7) // 8), "big")


def single(x: float) -> bytes:
    return struct.pack(">f", x)


def double(x: float) -> bytes:
    return struct.pack(">d", x)


def integer_value(value: str):
    """The unsigned big-endian integer of a binary column, of up to seven bytes."""
    return F.conv(F.hex(value), 16, 10).cast("long")


#: Blocks of a cluster: their times from its own have 16 bits.
CLUSTER = 800


@F.arrow_udf(BinaryType())
def audio_file(number: pa.Array, rate: pa.Array, times: pa.Array, blocks: pa.Array) -> pa.Array:
    """A small file for each row: a header, an audio track, and clusters of blocks at their times in milliseconds."""
    out = []
    for row in zip(number, rate, times, blocks):  # a file's numbers and blocks as Python objects at a time, not a batch's
        n, hertz, at, data = (x.as_py() for x in row)
        track = element("ae", [element("d7", integer(n)), element("83", integer(2)), element("86", b"A_VORBIS"), element("e1", [element("b5", single(hertz)), element("9f", integer(2))])])
        clusters = []
        for k in range(0, len(at), CLUSTER):
            own = zip(at[k : k + CLUSTER], data[k : k + CLUSTER])
            clusters.append(element("1f43b675", [element("e7", integer(at[k])), *(element("a3", b"\x81" + struct.pack(">h", t - at[k]) + b"\x80" + d) for t, d in own)]))
        header = element("1a45dfa3", [element("4286", integer(1)), element("4282", b"webm")])
        out.append(header + element("18538067", [element("1549a966", [element("2ad7b1", integer(1_000_000)), element("4489", double(float(at[-1] - at[0])))]), element("1654ae6b", [track]), *clusters]))
    return pa.array(out, pa.binary())
