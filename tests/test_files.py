"""Pictures, archives, photos and EBML files: round trips, damage, and empty and missing values."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sinks import files as X
from framewright.sources import ebml as E


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for width, height in ((1, 1), (7, 3), (64, 50)):
        rgb = rng.integers(0, 256, 3 * width * height, np.uint8).tobytes()
        data = X.png(width, height, rgb)
        assert X.png_pixels(data) == (width, height, rgb)
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        with pytest.raises(Exception):
            X.png_pixels(bytes(broken))
    with pytest.raises(ValueError):
        X.png_pixels(b"GIF89a")


def test_raw_photos(spark):
    """Files of an old photo's length are taken as they are; null planes make no photo."""
    old = b"\x01" * X.OLD_RAW_BYTES
    rows = spark.createDataFrame([(0, bytearray(gzip.compress(b"abc"))), (1, bytearray(old)), (2, None)], "k int, content binary")
    got = {r["k"]: r["raw"] for r in rows.select("k", X.raw_bytes(F.col("content"), F.length("content")).alias("raw")).collect()}
    assert bytes(got[0]) == b"abc" and bytes(got[1]) == old and got[2] is None
    planes = spark.createDataFrame([(b"abcd", b"e", b"f"), (b"abcd", None, b"f")], "y binary, u binary, v binary")
    assert [r[0] and gzip.decompress(bytes(r[0])) for r in planes.select(X.gzipped("y", "u", "v")).collect()] == [b"abcdef", None]


def test_archives_keep_all_files_in_order(spark, tmp_path):
    """Archives appended piece by piece are read by zipfile, checksums and names beyond ASCII included; two are of different sizes."""
    import zipfile

    from framewright.sinks.archive import zip_pieces
    from framewright.sinks.commit import append_files

    rows = [(v, k, f"/{v}/é{k:05d}", bytearray([v, k % 256]) * (k * 300 % 1000)) for v, n in ((0, 5), (1, 1), (2, 300)) for k in range(n)]
    files = spark.createDataFrame(rows, "video int, place int, name string, content binary").repartition(4)
    pieces = zip_pieces(files, "video")
    append_files(pieces.withColumn("name", F.concat("video", F.lit(".zip"))), str(tmp_path))
    for v in range(3):
        with zipfile.ZipFile(tmp_path / f"{v}.zip") as archive:
            assert archive.testzip() is None
            assert [(n, archive.read(n)) for n in archive.namelist()] == [(r[2], bytes(r[3])) for r in rows if r[0] == v]
    archives = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", r"(\d+)\.zip$", 1).cast("int").alias("video"), "content")
    found = X.zip_entries(archives, "video").orderBy("video", "place").collect()
    assert [(r["video"], r["place"], r["name"], r["content"]) for r in found] == rows
    with pytest.raises(Exception, match="65,535 files"):
        zip_pieces(spark.range(66_000).select(F.lit(1).alias("video"), F.col("id").alias("place"), F.lit("x").alias("name"), F.lit(b"").alias("content")), "video").filter("place.part = 2").collect()


def test_lengths_of_any_width():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**35, 2**48):
        for compat in (False, True):
            data = E.length_bytes(n, compat)
            assert E._vint(data, 0, False) == (n, len(data))
    assert E.length_bytes(64, compat=True).hex() == "4040" and E.length_bytes(64).hex() == "c0"


def test_elements_of_nested_files():
    inner = E.element("ae", [E.element("d7", E.integer(300)), E.element("e1", [])])
    data = E.element("18538067", [inner, E.element("a3", b"")]) + E.element("1a45dfa3", [E.element("4286", b"\x01")])
    got = [(f[1], f[2], f[3], f[6]) for f in E.elements(data)]
    assert got == [(0, None, "18538067", None), (1, 0, "ae", None), (2, 1, "d7", b"\x01\x2c"), (2, 1, "e1", None), (1, 0, "a3", b""), (0, None, "1a45dfa3", None), (1, 5, "4286", b"\x01")]
    assert [f[3] for f in E.elements(data[:12])] == [f[3] for f in E.elements(data)][: len(list(E.elements(data[:12])))]  # cut off: what is whole
    assert list(E.elements(b"")) == [] and list(E.elements(b"\x00\x00")) == []


def test_numbers_of_elements():
    assert E.integer(0) == b"\x00" and E.integer(5, 4) == b"\x00\x00\x00\x05" and E.integer(2**40).hex() == "010000000000"
    assert struct.unpack(">f", E.single(44100.0))[0] == 44100.0 and struct.unpack(">d", E.double(-1.25))[0] == -1.25
    assert E.is_container("1f43b675") and E.is_container("ae") and not E.is_container("a3") and not E.is_container("ff")


def test_parse_of_missing_files(spark):
    files = spark.createDataFrame([(0, None), (1, bytearray())], "k int, data binary")
    assert E.parse(files, "k").count() == 0


def test_containers_of_unknown_size():
    """Clusters without a size end where the next begins; a segment without one at the end of the file; known ones inside hold."""
    unknown = lambda id, body, width=8: bytes.fromhex(id) + ((1 << 7 * width + 1) - 1).to_bytes(width, "big") + body
    block = lambda k: E.element("a3", bytes([k]))
    clusters = [unknown("1f43b675", E.element("e7", E.integer(k)) + block(k) + block(k + 1), w) for k, w in ((0, 8), (1, 1), (2, 4))]
    data = E.element("1a45dfa3", [E.element("4286", b"\x01")]) + unknown("18538067", E.element("1549a966", [E.element("2ad7b1", b"\x01")]) + b"".join(clusters) + E.element("1654ae6b", [E.element("ae", [])]))
    got = [(f[1], f[2], f[3], f[5]) for f in E.elements(data)]
    segment = 2
    want = [(0, None, "1a45dfa3", 4), (1, 0, "4286", 1), (0, None, "18538067", None), (1, segment, "1549a966", 5), (2, 3, "2ad7b1", 1)]
    for k in range(3):
        want += [(1, segment, "1f43b675", None), (2, 5 + 4 * k, "e7", 1), (2, 5 + 4 * k, "a3", 1), (2, 5 + 4 * k, "a3", 1)]
    assert got == [*want, (1, segment, "1654ae6b", 2), (2, 17, "ae", 0)]
    twice = list(E.elements(data + data))
    assert [(f[1], f[3]) for f in twice] == 2 * [(f[1], f[3]) for f in E.elements(data)]
    inside = E.element("18538067", [unknown("1f43b675", block(7))]) + block(9)
    assert [(f[1], f[3]) for f in E.elements(inside)] == [(0, "18538067"), (1, "1f43b675"), (2, "a3"), (0, "a3")]


def test_lacing_and_clusters(spark):
    """Packets of any size come back; clusters begin anew before a block's 15 bits of time are used up."""
    from framewright.sinks import mux as M

    sizes = [0, 1, 254, 255, 256, 509, 510, 511, 3, 0, 255, 7, 40]
    rows = [(1, k, 20_000 * k, bytearray([k] * n)) for k, n in enumerate(sizes)]
    packets = spark.createDataFrame(rows, "video long, number long, at long, packet binary")
    for per in (1, 2, 5):
        pages = {r["number"]: r for r in M.pages(packets, per).collect()}
        back = [p for n in sorted(pages) for p in M.packets_of(bytes([2, 0, 0, M.XIPH if pages[n]["laced"] else 0]) + bytes(pages[n]["payload"]))]
        assert back == [bytes(r[3]) for r in rows] and [pages[n]["at"] for n in sorted(pages)] == [20_000 * k for k in range(0, 13, per)]
    video = spark.createDataFrame([(1, k, 9_000 * k, bytearray(b"x")) for k in range(40)], "video long, number long, at long, payload binary")
    own = M.placed(M.blocks(video, M.pages(packets, 2)))
    data = b"".join(bytes(r["content"]) for r in M.pieces(own).orderBy("place").collect())
    files = spark.createDataFrame([(1, bytearray(data))], "video long, data binary")
    found = M.unmuxed(E.parse(files, "video")).orderBy("block", "k").collect()
    assert [bytes(r["packet"]) for r in found if r["track"] == 2] == [bytes(r[3]) for r in rows]
    assert [r["at"] for r in found if r["track"] == 1] == [9_000 * k for k in range(40)]
    order = own.orderBy("place").select("kind", "at", "cluster").collect()
    assert [(1 if r["kind"] == "v" else 2, r["at"], r["cluster"]) for r in order] == [(r["track"], r["at"], r["cluster"]) for r in found if r["k"] == 0]
    with pytest.raises(ValueError):
        M.placed(own, 40_000)


def muxed_of_two():
    from framewright.sinks import mux as M

    return [(v, bytearray(M.HEADER + E.element("18538067", [M.info(0.0), M.TRACKS, *(E.element("1f43b675", [E.element("e7", E.integer(300 * c)), *(E.element("a3", bytes([0x81, 0, 7 * k, 0x80]) + bytes([k] * k)) for k in range(n))]) for c, n in enumerate(sizes))]))) for v, sizes in ((1, (2, 0, 3)), (2, (1,)))]


def test_packets_in_one_pass(spark, monkeypatch):
    """Files are read and parsed once, not once for each kind of element; rows leave in small batches."""
    from framewright.sinks import mux as M

    files = spark.createDataFrame([*muxed_of_two(), (3, None), (4, bytearray())], "video long, data binary")
    found = M.packets(files)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, M.unmuxed(E.parse(files, "video")).collect()))
    assert [r[:5] for r in got] == [(1, 0, 0, 1, 0), (1, 1, 0, 1, 7), (1, 2, 2, 1, 600), (1, 3, 2, 1, 607), (1, 4, 2, 1, 614), (2, 0, 0, 1, 0)]


def test_sizes_in_one_pass(spark):
    from framewright.sinks import mux as M

    own = muxed_of_two()
    found = M.sizes(spark.createDataFrame(own, "video long, data binary"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = []
    for v, data in own:
        sizes = [(f[3], f[5]) for f in E.elements(bytes(data))]
        want += [(v, -1, n, len(data)) for i, n in sizes if i == "18538067"]
        want += [(v, k, n, None) for k, n in enumerate(n for i, n in sizes if i == "1f43b675")]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == want


def test_sample_factor_is_that_of_columns(spark):
    from framewright.functions import numbers as N

    sizes = [(w, h) for w in (1, 299, 300, 301, 600, 601, 5000, 40_000) for h in (1, 200, 201, 799, 801, 6400)]
    rows = spark.createDataFrame(sizes, "w long, h long")
    got = {(r["w"], r["h"]): r["f"] for r in rows.withColumn("f", N.downsample_factor("w", "h", 300, 200)).collect()}
    assert got == {s: X.sample_factor(*s, 300, 200) for s in sizes}


def test_files_of_a_batch_are_made_one_by_one():
    """A batch of files is far smaller than its numbers and blocks as Python objects; only one file's are held."""
    import tracemalloc

    import pyarrow as pa

    n, k = 400, 500
    times, blocks = pa.array([list(range(0, k * 37, 37))] * n), pa.array([[b"12345678"] * k] * n, pa.list_(pa.binary()))
    tracemalloc.start()
    made = E.audio_file.func(pa.array([1] * n), pa.array([44100.0] * n), times, blocks)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == n and made[0] == made[n - 1]
    assert most < 14e6, most


def test_bytes_are_summed_without_numbers(spark):
    from framewright.sources import frames as R

    rows = spark.createDataFrame([(0, bytearray([255] * 3000)), (1, bytearray()), (2, None), (3, bytearray([1, 128]))], "k int, raw binary")
    assert [tuple(r) for r in rows.select("k", R.byte_sum("raw").alias("s")).orderBy("k").collect()] == [(0, 765_000), (1, 0), (2, 0), (3, 129)]
