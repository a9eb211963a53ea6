"""Muxing: blocks of pictures and pages of sound packets as EBML files, whose sizes are known before a byte is written.

Sizes come from below: of each block, of a cluster as the sum of its blocks, of a file as the sum of its clusters, all by groups over rows. A file is then its pieces
in order (a head, and for each cluster its head and its blocks), which a sink appends one by one, so no task holds a file. Order and clusters are running
values over slices, so one long video is many tasks until it is written.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.numbers import ebml_integer, ebml_length, ebml_length_bytes
from ..operators.planes import OUT_BYTES
from ..operators.slices import SLICE, Running, running, sliced
from ..session import staged
from ..sources import ebml as E

#: A block's time from its cluster's has 16 bits with a sign, so a cluster spans less than 32,768 ms.
CLUSTER_MS = 30_000
# Flags of a block: a key frame; several packets with Xiph's sizes.
KEY, XIPH = 0x80, 0x02
HEADER = E.element("1a45dfa3", [E.element("4286", E.integer(1)), E.element("4282", b"webm")])
TRACKS = E.element(
    "1654ae6b",
    [
        E.element("ae", [E.element("d7", E.integer(1)), E.element("73c5", E.integer(1)), E.element("83", E.integer(1)), E.element("86", b"V_VP8")]),
        E.element("ae", [E.element("d7", E.integer(2)), E.element("73c5", E.integer(2)), E.element("83", E.integer(2)), E.element("86", b"A_VORBIS"), E.element("e1", [E.element("b5", E.single(44100.0)), E.element("9f", E.integer(2))])]),
    ],
)


def info(ms: float) -> bytes:
    return E.element("1549a966", [E.element("2ad7b1", E.integer(1_000_000)), E.element("4489", E.double(ms))])


def _byte(n: Column) -> Column:
    return F.lpad(F.hex(n), 2, "0")


def pages(packets: DataFrame, per: int) -> DataFrame:
    """(video, number, at, laced, payload): so many packets (video, number, at, packet) a page, by number from 0; a page begins with its first packet.

    The sizes of all packets but the last stand before them, each as bytes of 255 and a rest. A page of one packet is that packet.
    """
    if not 1 <= per <= 256:
        raise ValueError("a page has 1 to 256 packets")
    grouped = packets.groupBy("video", F.floor(F.col("number") / per).alias("page")).agg(F.array_sort(F.collect_list(F.struct("number", "at", "packet"))).alias("p"))
    n = F.size("p")
    size = lambda x: F.length(x["packet"])
    sizes = F.transform(F.slice("p", 1, n - 1), lambda x: F.concat(F.repeat(F.lit("FF"), F.floor(size(x) / 255).cast("int")), _byte(size(x) % 255)))
    data = F.array_join(F.transform("p", lambda x: F.hex(x["packet"])), "")
    laced = F.concat(_byte(n - 1), F.array_join(sizes, ""), data)
    return grouped.select("video", F.col("page").alias("number"), F.col("p")[0]["at"].alias("at"), (n > 1).alias("laced"), F.unhex(F.when(n > 1, laced).otherwise(data)).alias("payload"))


def blocks(video: DataFrame, audio: DataFrame, last_ms: int = 1000) -> DataFrame:
    """(video, kind, number, at, by, laced, payload): of pictures (video, number, at, payload) and pages, with the time by which they are ordered.

    A page stands before the pictures that the next page's time doesn't pass; the last one counts last_ms.
    """
    line = running(sliced(audio, "video", ["number"]), "video", ["number"], {"following": Running("last", F.col("at"), back=True)})
    sound = line.select("video", F.lit("a").alias("kind"), "number", "at", F.coalesce("following", F.col("at") + last_ms).alias("by"), "laced", "payload")
    return video.select("video", F.lit("v").alias("kind"), "number", "at", F.col("at").alias("by"), F.lit(False).alias("laced"), "payload").unionByName(sound)


def placed(own: DataFrame, cluster_ms: int = CLUSTER_MS) -> DataFrame:
    """blocks with place, in order, and cluster: a new one begins where the block's time lies in another span of cluster_ms than that of the block before."""
    if not 1 <= cluster_ms < 1 << 15:
        raise ValueError("a block's time from its cluster's has 15 bits")
    order = ["by", "kind", "number"]
    span = F.floor(F.col("at") / cluster_ms)
    line = running(sliced(own, "video", order), "video", order, {"place": Running("count", F.lit(1)), "__before": Running("last", span)})
    line = line.withColumn("__cut", F.when(F.col("__before") == span, 0).otherwise(1).cast("long"))
    line = running(line, "video", order, {"__cuts": Running("sum", F.col("__cut"))})
    return line.withColumn("cluster", F.col("__cuts") + F.col("__cut") - 1).drop("__before", "__cut", "__cuts", SLICE)


@F.arrow_udf(BinaryType())
def _head(ms: pa.Array, size: pa.Array) -> pa.Array:
    """What stands before a file's clusters: size is theirs together."""
    out = []
    for t, n in zip(ms.to_pylist(), size.to_pylist()):
        own = info(float(t)) + TRACKS
        out.append(HEADER + bytes.fromhex("18538067") + E.length_bytes(len(own) + n) + own)
    return pa.array(out, pa.binary())


def pieces(own: DataFrame) -> DataFrame:
    """(video, place, content) of placed blocks: laid one after another by place, a struct, they are the files.

    Blocks are staged, as heads, starts and the blocks themselves all need them, and their places are running values.
    """
    body = 4 + F.length("payload")
    own = staged(own).withColumns({"body": body, "whole": 1 + ebml_length_bytes(body) + body})
    clusters = own.groupBy("video", "cluster").agg(F.min("at").alias("begin"), F.max("at").alias("end"), F.sum("whole").alias("of_blocks"))
    time = ebml_integer("begin")
    time_size = F.floor(F.length(time) / 2)
    content = 1 + ebml_length_bytes(time_size) + time_size + F.col("of_blocks")
    clusters = clusters.withColumns({"content": content, "whole": 4 + ebml_length_bytes(content) + content})
    files = clusters.groupBy("video").agg((F.max("end") - F.min("begin")).alias("ms"), F.sum("whole").alias("size"))
    at = lambda a, b: F.struct(a.cast("long").alias("cluster"), b.cast("long").alias("block"))
    none = F.lit(-1)
    heads = files.select("video", at(none, none).alias("place"), _head("ms", "size").alias("content"))
    starts = clusters.select("video", at(F.col("cluster"), none).alias("place"), F.unhex(F.concat(F.lit("1f43b675"), ebml_length("content"), F.lit("e7"), ebml_length(time_size), time)).alias("content"))
    timed = own.join(clusters.select("video", "cluster", "begin"), ["video", "cluster"])
    flags = F.when(F.col("laced"), KEY | XIPH).otherwise(KEY)
    front = F.concat(F.lit("a3"), ebml_length("body"), F.when(F.col("kind") == "v", "81").otherwise("82"), F.lpad(F.hex(F.col("at") - F.col("begin")), 4, "0"), _byte(flags))
    return heads.unionByName(starts).unionByName(timed.select("video", at(F.col("cluster"), F.col("place")).alias("place"), F.concat(F.unhex(front), "payload").alias("content")))


def unmuxed(elements: DataFrame) -> DataFrame:
    """(video, block, cluster, track, at, k, packet) of E.parse()'s elements of files: each packet of each block, in order."""
    own = elements.select("video", "place", "parent", "id", "value")
    times = own.filter("id = 'e7'").select("video", "parent", E.integer_value("value").alias("begin"))
    found = own.filter("id = 'a3'").select("video", "place", "parent", "value").join(times, ["video", "parent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for video, place, cluster, begin, value in zip(*(c.to_pylist() for c in batch.columns)):
                for k, packet in enumerate(packets_of(value)):
                    for out, x in zip(rows, (video, place, cluster, value[0] & 0x7F, begin + struct.unpack_from(">h", value, 1)[0], k, packet)):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (batch.column(0).type, *[pa.int64()] * 5, pa.binary()))], ["video", "place", "cluster", "track", "at", "k", "packet"])

    kind = elements.schema["video"].dataType.simpleString()
    each = found.select("video", F.col("place").cast("long"), F.col("parent").cast("long"), "begin", "value").mapInArrow(run, f"video {kind}, place long, cluster long, track long, at long, k long, packet binary")
    # the number of a block or a cluster among those of its file
    blocks_ = running(sliced(each.filter("k = 0").select("video", "place", "cluster"), "video", ["place"]), "video", ["place"], {"block": Running("count", F.lit(1))}).drop(SLICE)
    clusters = running(sliced(own.filter("id = '1f43b675'").select("video", F.col("place").cast("long").alias("cluster")), "video", ["cluster"]), "video", ["cluster"], {"of": Running("count", F.lit(1))}).drop(SLICE)
    numbers = blocks_.join(clusters, ["video", "cluster"]).select("video", "place", "block", "of")
    return each.drop("cluster").join(numbers, ["video", "place"]).select("video", "block", F.col("of").alias("cluster"), "track", "at", "k", "packet")


def packets(files: DataFrame, key: str = "video", data: str = "data") -> DataFrame:
    """What unmuxed() gives of E.parse()'s elements, of files (key, data) in one pass: blocks and clusters are numbered as they are parsed."""
    kind = files.schema[key].dataType.simpleString()

    def rows(name: object, content: bytes) -> Iterator[tuple[tuple, int]]:
        block, numbers, begins = 0, {}, {}
        for place, _, parent, id, _, _, value in E.elements(content):
            if id == "1f43b675":
                numbers[place] = len(numbers)
            elif id == "e7":
                begins[parent] = int.from_bytes(value, "big")
            elif id == "a3":
                at = begins[parent] + struct.unpack_from(">h", value, 1)[0]
                for k, packet in enumerate(packets_of(value)):
                    yield (name, block, numbers[parent], value[0] & 0x7F, at, k, packet), len(packet)
                block += 1

    return _in_one_pass(files.select(key, data), rows, f"{key} {kind}, block long, cluster long, track long, at long, k long, packet binary", pa.binary())


def _in_one_pass(files: DataFrame, rows: Callable[..., Iterator[tuple[tuple, int]]], schema: str, last: pa.DataType) -> DataFrame:
    """The rows of files, whose columns are whole numbers but for the first and the last; they leave in batches of some MB, whatever the files' sizes are. rows: a row with its bytes."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, kind = [], 0, None

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (kind, *[pa.int64()] * (len(names) - 2), last))], names)

        for batch in batches:
            kind = batch.column(0).type
            for own in zip(*batch.columns):
                name, content = (x.as_py() for x in own)
                for row, n in rows(name, content or b""):
                    made.append(row)
                    size += n + 64
                    if size >= OUT_BYTES:
                        yield batch_of()
                        made, size = [], 0
        if made:
            yield batch_of()

    return files.mapInArrow(run, schema)


def sizes(files: DataFrame, key: str = "video", data: str = "data") -> DataFrame:
    """(key, cluster, size, length) of files (key, data): what each cluster tells, by number, and what the segment tells, as -1, beside the file's own length."""
    kind = files.schema[key].dataType.simpleString()

    def rows(name: object, content: bytes) -> Iterator[tuple[tuple, int]]:
        n = 0
        for _, _, _, id, _, size, _ in E.elements(content):
            if id == "18538067":
                yield (name, -1, size, len(content)), 0
            elif id == "1f43b675":
                yield (name, n, size, None), 0
                n += 1

    return _in_one_pass(files.select(key, data), rows, f"{key} {kind}, cluster long, size long, length long", pa.int64())


def packets_of(block: bytes) -> list[bytes]:
    """The packets of a block: one, or several with Xiph's sizes."""
    flags, data = block[3], block[4:]
    if not flags & 0x06:
        return [data]
    if flags & 0x06 != XIPH:
        raise ValueError("sizes of another kind")
    n, at, sizes = data[0] + 1, 1, []
    while len(sizes) < n - 1:
        size = 0
        while data[at] == 255:
            size, at = size + 255, at + 1
        sizes.append(size + data[at])
        at += 1
    out = []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return [*out, data[at:]]
