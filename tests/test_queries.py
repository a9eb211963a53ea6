"""Every query against its SQL in DuckDB, and the values that the operators' definitions fix."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright import registry
from framewright.functions import numbers as N
from framewright.functions import pixels as P
from framewright.operators import audio as A
from framewright.operators import stencil as T
from framewright.sources import ebml as E
from framewright.sources import frames as R

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.endswith(("_all", "_whole"))))  # those are older names
def test_query_equals_sql(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((rounded(r) for r in df.select(*columns).collect()), key=repr)
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    assert got == sorted((rounded(tuple(r[k] for k in place)) for r in found.fetchall()), key=repr)


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x long").select("k", *columns).orderBy("k").drop("k").collect()]


def test_levels(spark):
    x = [0, 42, 43, 85, 127, 128, 170, 212, 213, 255]
    assert [v for (v,) in values(spark, x, P.quantise4(F.col("x")))] == [0, 0, 85, 85, 85, 170, 170, 170, 255, 255]
    assert values(spark, [0, 128, 255], *P.colour_map("x", (0, 0, 0), (255, 255, 255))) == [(0, 0, 0), (128, 128, 128), (255, 255, 255)]
    assert values(spark, [73, 146, 219], P.char_index("x", 7, 256), P.char_index("x", 7, 255)) == [(1, 2), (3, 4), (5, 6)]
    assert [v for (v,) in values(spark, [128, 0, 1], P.flip_chroma("x"))] == [128, 0, 255]


def test_lengths(spark):
    assert [v for (v,) in values(spark, [1, 126, 127, 128], N.ebml_length("x"))] == ["81", "fe", "407f", "4080"]
    assert [v for (v,) in values(spark, [1, 64, 127], N.ebml_length("x", compat=True))] == ["81", "4040", "407f"]


def test_properties(spark, sf):
    px = R.event_pixels(spark, sf).cache()
    flat = px.withColumn("yy", F.lit(77))
    assert T.edges(flat, 40, 25).filter("edge <> 0").isEmpty()
    assert T.box_blur(flat, ["yy"], 4, 40, 25).filter("yy <> 77").isEmpty()
    assert T.convolve3x3(px, T.KERNELS["identity"]).filter("conv <> yy").isEmpty()
    with pytest.raises(ValueError):
        T.convolve3x3(px, (1, 2))
    planes = R.to_planes(px, 40, 25)
    back = R.to_pixels(planes).select("frame_id", "x", "y", "yy", "uu", "vv")
    assert back.exceptAll(px.select(*back.columns)).isEmpty() and back.count() == px.count()


def test_whole_texts(spark, sf):
    """Each byte of a text is decoded, not a prefix's."""
    size = F.length(F.encode("text", "UTF-8"))
    want = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.floor(size / 2)), F.sum(F.floor(size / 12))).first()
    got = [registry.QUERIES[name](spark, sf).count() for name in ("pcm_decode", "plane_slice")]
    assert got == list(want)


def test_bytes_of_a_batch_take_no_more_memory_as_numbers(spark):
    """A batch's bytes become arrays in no more than the batch's memory; every byte, nulls, empty ones and slices keep their values, as do pixels and samples made of them."""
    rows = [bytes(range(256)), None, b"", b"\xff\x80\x00", bytes(range(255, -1, -1)) * 40]
    for data in (pa.array(rows, pa.binary()), pa.array(rows, pa.binary())[1:], pa.array(rows, pa.large_binary()), pa.array([None, None], pa.binary()), pa.array([], pa.binary())):
        own = R.byte_values.func(data)
        own.validate(full=True)
        assert [[v % 256 for v in x or ()] for x in own.to_pylist()] == [list(x or b"") for x in data.to_pylist()]
        assert own.nbytes <= data.nbytes
    df = spark.createDataFrame([(k, None if r is None else bytearray(r)) for k, r in enumerate(rows)], "k long, raw binary")
    for width, row, pixel in ((4, 12, 2), (5, 7, 1), (9, 10, 3)):
        want = [(k, x, y, r[y * row + x * pixel]) for k, r in enumerate(rows) if r for y in range(-(-len(r) // row)) for x in range(width) if x * pixel < row and y * row + x * pixel < len(r)]
        assert sorted(map(tuple, R.without_strides(df, width, row, pixel).collect())) == sorted(want)
    samples = [(k, i, int.from_bytes(r[2 * i : 2 * i + 2], "little", signed=True)) for k, r in enumerate(rows) if r for i in range(len(r) // 2)]
    assert sorted(map(tuple, A.decode_pcm(df).collect())) == samples


def test_pixels_take_one_python_step(spark):
    """Planes become pixels by one Python step, and so one worker a task; planes that are empty, missing or short give the pixels that are there."""
    rows = [(0, 2, 2, b"\x00\x7f\x80\xff", b"\xfe", b"\x01"), (1, 3, 1, b"abc", b"\x81", None), (2, 2, 2, b"", b"x", b"y"), (3, 2, 2, None, b"x", b"y")]
    own = R.to_pixels(spark.createDataFrame(rows, "frame_id long, width int, height int, yp binary, up binary, vp binary"))
    want = [(0, 0, 0, 0, 254, 1), (0, 1, 0, 127, 254, 1), (0, 0, 1, 128, 254, 1), (0, 1, 1, 255, 254, 1), (1, 0, 0, 97, 129, None), (1, 1, 0, 98, 129, None), (1, 2, 0, 99, None, None)]
    assert sorted(map(tuple, own.collect()), key=str) == sorted(want, key=str)
    assert own._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_all_events_take_part(spark, sf):
    """No subset of frames or events is left: pixels, bases, and more drops than one in ten has."""
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert [registry.QUERIES[name](spark, sf).count() for name in ("tile_touch", "next_frame_asof")] == [n, n]


def test_numbers_of_large_ids(spark, tmp_path):
    """EBML lengths and integers of ids whose cubes have far more than 63 bits, against Python's whole numbers."""
    ids = [0, 1, 5, 99_999, 667_000, 2_097_152, 5_999_999, 36_000_001, 10**12 + 7]
    spark.createDataFrame([(k, k % 1501) for k in ids], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = {k: (k**3 * 31 + k % 1501) % (1 << 42) for k in ids}
    found = {r["event_id"]: r for r in registry.QUERIES["ebml_length"](spark, str(tmp_path)).collect()}
    assert {k: r["v"] for k, r in found.items()} == want
    assert all(E.length_bytes(want[k]).hex() == r["bytes"] for k, r in found.items())
    assert {r["event_id"]: r["bytes"] for r in registry.QUERIES["ebml_integer"](spark, str(tmp_path)).collect()} == {k: E.integer(v).hex() for k, v in want.items()}
    a, b = (1 << 42) - 1, (1 << 41) + 12345
    assert values(spark, [a, b, 7], N.product_modulo(F.col("x"), F.lit(a), 42), N.product_modulo(F.col("x"), F.lit(-3), 9)) == [(x * a % (1 << 42), x * -3 % 512) for x in (a, b, 7)]


def test_modes_of_discs_send_no_rows(spark):
    """Discs against plain counting, where pixels are missing; there is no row for each place of a disc, and nothing is broadcast."""
    rng = random.Random(3)
    rows = [(f, x, y, rng.randrange(5), rng.randrange(2, 5)) for f in (7, 9) for x in range(2, 13) for y in range(9) if rng.random() < 0.8]
    own = T.disc_mode(spark.createDataFrame(rows, "frame_id long, x int, y int, colour long, radius int"), 4)
    want = {}
    for f, x, y, _, r in rows:
        seen = [c for g, a, b, c, _ in rows if g == f and (a - x) ** 2 + (b - y) ** 2 <= r * r]
        want[f, x, y] = min(set(seen), key=lambda c: (-seen.count(c), c))
    assert {(r["frame_id"], r["x"], r["y"]): r["mode"] for r in own.collect()} == want
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan
