"""Running values over slices of a hot key: against plain loops, and with a video of a million frames in bounded tasks."""

import random

from pyspark.sql import functions as F

from framewright.operators import timeline as T
from framewright.operators.slices import SLICE, Running, running, sliced


def plainly(rows, back):
    """For rows (key, t, v) in order: count, sum, min, max and last of v before each (after it), nulls aside."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0))
        seen = []
        for r in reversed(own) if back else own:
            out[r[:2]] = (len(seen), sum(seen), min(seen, default=None), max(seen, default=None), seen[-1] if seen else None)
            if r[2] is not None:
                seen.append(r[2])
    return out


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.choice([None, rng.randrange(-50, 50)])) for k, n in ((0, 300), (1, 1), (2, 40), (None, 25)) for t in rng.sample([None, *range(1000)], n)]
    cut = sliced(spark.createDataFrame(rows, "video long, t long, v long").repartition(3), "video", ["t"], 7)
    kinds = ("count", "sum", "min", "max", "last")
    for back in (False, True):
        got = running(cut, "video", ["t"], {f"{k}_": Running(k, F.col("v"), back=back) for k in kinds}).collect()
        assert {(r["video"], r["t"]): tuple(r[f"{k}_"] for k in kinds) for r in got} == plainly(rows, back) and len(got) == len(rows)
    whole = running(cut, "video", ["t"], {f"{k}_": Running(k, F.col("v"), whole=True) for k in kinds[:4]}).collect()
    for r in whole:
        own = [v for k, _, v in rows if k == r["video"] and v is not None]
        assert tuple(r[f"{k}_"] for k in kinds[:4]) == (len(own), sum(own) if own else None, min(own, default=None), max(own, default=None))
    assert running(sliced(spark.createDataFrame([], "video long, t long, v long"), "video", ["t"]), "video", ["t"], {"n": Running("count", F.col("v"))}).count() == 0


def test_a_hot_video_is_many_tasks(spark):
    """A million frames of one video, two thirds at one time, beside small ones: no slice holds more than its share, and the results are exact."""
    n = 1_000_000
    ms = F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(n)
    hot = spark.range(n).select(F.lit(7).cast("long").alias("video"), ms.alias("ms"), F.col("id").alias("event_id"))
    few = spark.range(300).select((F.col("id") % 50 + 100).alias("video"), F.col("id").alias("ms"), F.col("id").alias("event_id"))
    slices = 16
    line = running(sliced(hot.unionByName(few), "video", ["ms", "event_id"], slices), "video", ["ms", "event_id"], {"frame": Running("count", F.lit(1))})
    assert line.groupBy("video", SLICE).count().agg(F.max("count")).first()[0] < 1.5 * n / slices
    got = line.filter("video = 7").agg(F.count("frame"), F.countDistinct("frame"), F.min("frame"), F.max("frame")).first()
    assert tuple(got) == (n, n, 0, n - 1)
    assert line.filter("video = 7 AND ms < 1000000").filter(F.col("frame") != F.floor(F.col("ms") / 3)).isEmpty()

    def plan(df):
        return df._jdf.queryExecution().toString()

    for df in (T.frame_times(line), T.next_frame(line, line.select("video", F.col("frame").alias("base"), F.lit(5).cast("long").alias("delta_ms"))), T.frame_durations(line)):
        # windows over rows go by slice; those by video alone see a row for each slice
        own = [w for w in plan(df).split("== Physical Plan ==")[0].splitlines() if "Window [" in w and "__here" in w]
        assert own and all(SLICE in w for w in own)
    times = T.frame_times(line)
    assert times.agg(F.max("pts_us")).first()[0] == n * 1000
    next_ = T.next_frame(line, line.filter("frame % 1000 = 0").select("video", F.col("frame").alias("base"), F.lit(2).cast("long").alias("delta_ms")))
    # hot frames of different times are three ms apart; the last third has no later frame
    bad = next_.filter("video = 7").filter(F.col("next") != F.when(F.col("base") < 333_333, F.col("base") + 1).otherwise(n - 1))
    assert bad.isEmpty() and next_.count() == 1050


def test_nearest_frame_ties(spark):
    frames = spark.createDataFrame([(0, k, t) for k, t in enumerate([0, 10, 10, 10, 20, 20])], "video long, frame long, ms long")
    asks = spark.createDataFrame([(0, k, t) for k, t in enumerate([-5, 0, 5, 6, 10, 15, 16, 99])] + [(1, 0, 3)], "video long, k long, at_ms long")
    got = {(r["video"], r["k"]): r["frame"] for r in T.nearest_frame(frames, asks).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 3): 1, (0, 4): 1, (0, 5): 1, (0, 6): 4, (0, 7): 4, (1, 0): None}


def test_interleaving_of_left_over_pages(spark):
    video = spark.createDataFrame([(0, 0, 0), (0, 1, 100)], "video long, number long, at long")
    audio = spark.createDataFrame([(0, k, 40 * k) for k in range(5)], "video long, number long, at long")
    got = T.interleaved(video, T.followed(audio, 40)).orderBy("place").collect()
    assert [(r["place"], r["kind"], r["number"]) for r in got] == [(0, "v", 0), (1, "a", 0), (2, "a", 1), (3, "v", 1), (4, "a", 2), (5, "a", 3), (6, "a", 4)]


def test_running_mean_over_slices(spark):
    """Short slices and long ones: the last ten values, wherever the cuts are, nulls aside."""
    rng = random.Random(5)
    rows = [(v, k, rng.choice([None, *range(20)])) for v, n in ((0, 95), (1, 3), (2, 1)) for k in range(n)]
    frames = spark.createDataFrame(rows, "video long, frame long, took long").repartition(3)
    for slices in (1, 4, 40):
        got = {(r["video"], r["frame"]): r["mean"] for r in T.running_mean(sliced(frames, "video", ["frame"], slices), "took").collect()}
        assert len(got) == len(rows)
        for v, k, _ in rows:
            own = [x for w, j, x in rows if w == v and k - 9 <= j <= k and x is not None]
            assert got[v, k] == (sum(own) / len(own) if own else None)
    one = {(r["video"], r["frame"]): r["mean"] for r in T.running_mean(frames, "took", last=1).collect()}
    assert one == {(v, k): x for v, k, x in rows}


def test_nearest_at_steps(spark):
    """As nearest_frame() of sample_times(), with frames of equal times and ties; times are made after the last sort, so that none is sorted or kept."""
    rng = random.Random(5)
    rows = []
    for v, n, most in ((1, 60, 9), (2, 1, 9), (3, 40, 400), (4, 5, 0)):
        at = sorted(rng.randint(0, n * most // 3) - 50 for _ in range(n))
        rows += [(v, k, ms) for k, ms in enumerate(at)]
    frames = spark.createDataFrame(rows, "video long, frame long, ms long")
    for step in (1, 2, 7, 100_000):
        found = T.nearest_at_steps(frames, step)
        want = sorted(map(tuple, T.nearest_frame(frames, T.sample_times(frames, step)).collect()))
        assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Window")
