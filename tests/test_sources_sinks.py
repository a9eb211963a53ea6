"""Raw frames by byte ranges, the committing sink of files, arriving frames, state that ends, and the recorder."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators.planes import KERNELS
from framewright.sinks.commit import append_files, stream_files, write_files
from framewright.sources.raw_frames import frames_at, raw_frames
from framewright.streaming import arrivals as A
from framewright.streaming import rules as U
from framewright.streaming.ending import over_ending_stream
from framewright.streaming.recorder import recorder


def files(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names}


def test_frames_of_a_large_file(spark, tmp_path):
    """A sparse file of 3 GB: frames are read alone, by ranges and by asking; ends and a short rest too."""
    record, n = 1 << 20, 3000
    path = tmp_path / "big.raw"
    with open(path, "wb") as out:
        for k in (0, 1234, n - 1):
            out.seek(k * record)
            out.write(k.to_bytes(4, "big"))
        out.truncate(n * record + 17)
    head = lambda k: f"{k if k in (0, 1234, n - 1) else 0:08X}"
    shown = lambda df: [(r["frame"], r["h"], r["n"]) for r in df.select("frame", F.hex(F.substring("raw", 1, 4)).alias("h"), F.length("raw").alias("n")).orderBy("frame").collect()]
    for first, end in ((1234, 1235), (n - 2, n + 5), (0, 2), (n, n + 1)):
        some = raw_frames(spark, str(path), record, first, end)
        assert some.rdd.getNumPartitions() == 1  # not the whole file's
        assert shown(some) == [(k, head(k), record) for k in range(first, min(end, n))]
    assert raw_frames(spark, str(path), record).rdd.getNumPartitions() == 47
    two = raw_frames(spark, str(path), record, 0, 2).union(raw_frames(spark, str(path), record, n - 1))
    assert shown(two) == [(k, head(k), record) for k in (0, 1, n - 1)]
    asks = spark.createDataFrame([(str(path), k, f"a{k}", None) for k in (1234, 5, 1234, n - 1, n, -1)] + [(None, 3, "x", None), (str(path), None, "y", None)], "file string, frame long, tag string, none string")
    got = sorted(((r["tag"], r["frame"], r["raw"] and bytes(r["raw"][:4]).hex().upper()) for r in frames_at(asks, record).collect()), key=str)
    assert got == sorted([(f"a{k}", k, head(k)) for k in (1234, 5, 1234, n - 1)] + [(f"a{n}", n, None), ("a-1", -1, None), ("x", 3, None), ("y", None, None)], key=str)


def test_frames_of_a_folder(spark, tmp_path):
    for name, data in (("a.raw", b"abcdef"), ("b/c.raw", b"ghi"), ("_hidden.raw", b"xxx"), ("empty.raw", b""), ("short.raw", b"z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for address in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        got = raw_frames(spark, address, 3, partition_bytes=3).orderBy("file", "frame").collect()
        assert [(os.path.relpath(r["file"], tmp_path), r["frame"], bytes(r["raw"])) for r in got] == [("a.raw", 0, b"abc"), ("a.raw", 1, b"def"), ("b/c.raw", 0, b"ghi")]
    assert raw_frames(spark, str(tmp_path / "none"), 3).count() == 0


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("d%d/%03d.bin", F.col("id") % 3, "id").alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content")).repartition(5)
    folder = str(tmp_path / "good")
    write_files(rows, folder)
    want = {f"d{k % 3}/{k:03d}.bin": str(k).encode() for k in range(40)}
    assert files(folder) == want

    @F.udf("binary")
    def broken(k):
        if k == 39:
            raise ValueError("a bad frame")
        return b"x"

    folder = str(tmp_path / "bad")
    os.makedirs(f"{folder}/d0")
    open(f"{folder}/d0/000.bin", "wb").write(b"old")
    with pytest.raises(Exception, match="a bad frame"):
        write_files(spark.range(40).repartition(4).select(F.format_string("d0/%03d.bin", "id").alias("name"), broken("id").alias("content")), folder)
    assert files(folder) == {"d0/000.bin": b"old"} and os.listdir(folder) == ["d0"]
    with pytest.raises(Exception, match="lie apart"):
        write_files(spark.range(8).repartition(4).select(F.lit("same").alias("name"), F.lit(b"x").alias("content")), folder)
    with pytest.raises(Exception, match="no name"):
        write_files(spark.createDataFrame([("../x", bytearray(b"x"))], "name string, content binary"), folder)
    assert files(folder) == {"d0/000.bin": b"old"} and os.listdir(folder) == ["d0"]
    write_files(spark.createDataFrame([("d0/000.bin", bytearray(b"new")), ("empty", None)], "name string, content binary"), f"file://{folder}")
    assert files(folder) == {"d0/000.bin": b"new", "empty": b""}


def test_appended_parts_keep_their_order(spark, tmp_path):
    parts = spark.range(500).select(F.concat(F.lit("v"), F.col("id") % 3).alias("name"), F.col("id").alias("place"), F.encode(F.format_string("%03d", "id"), "UTF-8").alias("content")).repartition(7)
    append_files(parts, str(tmp_path))
    assert files(tmp_path) == {f"v{v}": "".join(f"{k:03d}" for k in range(v, 500, 3)).encode() for v in range(3)}


FRAMES = "video long, event_id long, ms long"


def frames_table(spark, n=200):
    rng = random.Random(2)
    return spark.createDataFrame([(k % 3, k, k * 10 - rng.choice([0, 0, 400])) for k in range(n)], FRAMES)


def test_source_conflates_and_goes_on_after_a_restart(spark, tmp_path):
    rows, path, seen = frames_table(spark), str(tmp_path / "in"), []

    def start(admit, folder):
        stream = A.arrivals(spark, path, rows.schema, "event_id", "video", admit)
        return stream.writeStream.foreachBatch(lambda batch, k: seen.append((k, sorted(map(tuple, batch.collect()))))).option("checkpointLocation", str(tmp_path / folder)).start()

    arrived = lambda low, high: A.append_arrivals(rows.filter((F.col("event_id") >= low) & (F.col("event_id") < high)), path, "video")
    last = lambda low, high: [max((r for r in map(tuple, rows.collect()) if low <= r[1] < high and r[0] == v), key=lambda r: r[1]) for v in range(3)]
    arrived(0, 90)
    query = start("latest", "state")
    query.processAllAvailable()
    query.stop()
    arrived(90, 120)  # while nothing runs
    arrived(120, 150)
    query = start("latest", "state")
    query.processAllAvailable()
    arrived(150, 200)
    query.processAllAvailable()
    query.stop()
    assert [b for b in seen if b[1]] == [(0, last(0, 90)), (1, last(90, 150)), (2, last(150, 200))]
    seen.clear()
    query = start("all", "other")
    query.processAllAvailable()
    query.stop()
    assert sorted(r for _, b in seen for r in b) == sorted(map(tuple, rows.collect()))


def test_an_append_counts_when_it_is_complete(spark, tmp_path):
    rows, path = frames_table(spark, 30), str(tmp_path / "in")
    A.append_arrivals(rows, path, "video")
    reader = A.ArrivalsReader(path, "event_id", "video", "all", None)
    assert reader.latestOffset() == {"next": 30}
    (done,) = [os.path.join(d, "_SUCCESS") for d, _, names in os.walk(path) if "_SUCCESS" in names]
    os.remove(done)
    assert A.ArrivalsReader(path, "event_id", "video", "all", None).latestOffset() == {"next": 0}


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).count()


def test_state_of_idle_keys_ends_and_a_restart_gives_the_same(spark, tmp_path):
    """Keys 0 to 9 have frames in the first slice alone: their state is gone in the end; the rows are those of one run and of the table."""
    rows = [(v, k, 1000 * k) for v in range(10) for k in range(4)] + [(20, k, 1000 * k) for k in range(200)]
    frames = spark.createDataFrame(rows, "video long, frame long, ms long").withColumn("at", F.timestamp_millis(F.col("ms") + 86_400_000))
    rule = U.falling_drops(5000, 3, 4)
    path, got = str(tmp_path / "in"), {}

    def go(name, bounds):
        out = str(tmp_path / name)
        for low, high in bounds:  # a query for each slice: it goes on from the checkpoint
            if name == "first":
                A.append_arrivals(frames.filter((F.col("frame") >= low) & (F.col("frame") < high)), path, "video")
            stream = over_ending_stream(A.arrivals(spark, path, frames.schema, "frame", "video"), rule, "at", "1 second", 20_000)
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").start()
            query.processAllAvailable()
            query.stop()
        got[name] = sorted(map(tuple, spark.read.parquet(out).collect()))

    go("first", [(0, 10), (10, 100), (100, 200)])
    go("second", [(0, 200)])
    assert got["first"] == got["second"] == sorted(map(tuple, U.over_table(frames, rule).collect()))
    assert state_rows(spark, f"{tmp_path}/first-state") == 1


def test_recorder_writes_each_file_once_after_a_stop(spark, tmp_path):
    """The job stops between its two sinks; begun again, it leaves the files of a run without a stop."""
    rng = np.random.default_rng(3)
    w, h = 8, 6
    rows = [(k % 2, k, w, h, *(bytearray(rng.integers(0, 256, n, np.uint8).tobytes()) for n in (w * h, w * h // 4, w * h // 4))) for k in range(12)]
    frames = spark.createDataFrame(rows, "video long, frame_id long, width int, height int, yp binary, up binary, vp binary")
    path, failures = str(tmp_path / "in"), [1]

    def stop_once(batch):
        if batch == 1 and failures:
            failures.pop()
            raise RuntimeError("pulled out")

    def go(folder, between):
        stream = A.arrivals(spark, path, frames.schema, "frame_id", "video", "latest")
        query = recorder(stream, KERNELS["edge_luminance"], str(tmp_path / folder), str(tmp_path / f"{folder}-state"), between).start()
        query.processAllAvailable()
        query.stop()

    for k in range(3):
        A.append_arrivals(frames.filter((F.col("frame_id") >= 4 * k) & (F.col("frame_id") < 4 * k + 4)), path, "video")
        go("plain", lambda batch: None)
        if k == 1:
            with pytest.raises(Exception, match="pulled out"):
                go("stopped", stop_once)
            assert any(f"{10 - 3:012d}" in n for n in files(tmp_path / "stopped"))  # photos of the batch are there, its video isn't
        go("stopped", stop_once)
    assert not failures and files(tmp_path / "plain") == files(tmp_path / "stopped")
    latest = {4 * k + 2 + v: v for k in range(3) for v in range(2)}
    assert sorted(n for n in files(tmp_path / "plain") if n.startswith("photos")) == [f"photos/{k:012d}.png" for k in sorted(latest)]
    video = {n: d for n, d in sorted(files(tmp_path / "plain").items()) if n.startswith("video/0/")}
    assert b"".join(video.values()) == b"".join(b"".join(map(bytes, r[4:])) for r in rows if r[1] in (2, 6, 10))


def test_stream_sink_commits_batches(spark, tmp_path):
    rows = frames_table(spark, 30)
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    A.append_arrivals(rows, path, "video")
    stream = A.arrivals(spark, path, rows.schema, "event_id", "video")
    own = stream.select(F.format_string("%d/%d.txt", "video", "event_id").alias("name"), F.encode(F.col("ms").cast("string"), "UTF-8").alias("content"))
    query = stream_files(own, folder, str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert files(folder) == {f"{v}/{k}.txt": str(ms).encode() for v, k, ms in map(tuple, rows.collect())}
