"""Rules that carry state, step by step and against brute force; a stream gives what the table gives."""

import random

from pyspark.sql import functions as F

from framewright.streaming import replay as S
from framewright.streaming import rules as U


def steps(rule, rows):
    state, out = rule.start, []
    for row in rows:
        state, more = rule.step(state, row)
        out += more
    return out


def test_queue_carries_what_waits():
    """Three frames in each of two slots: a queue that is never empty loses frames of the second."""
    times = [0, 1, 2, 100, 101, 102, 103, 5000]
    lost = [r[2] for r in steps(U.bounded_queue(2, 90), [(7, k, t, k) for k, t in enumerate(times)])]
    # served at 0, 90, 180, then 270: at 100 one waits, at 101 two do
    assert lost == [False, False, False, False, True, True, True, False]


def test_queue_against_brute_force():
    rng = random.Random(1)
    for room, service in ((1, 5), (3, 20)):
        at, free, begins, want, rows = 0, -1, [], [], []
        for k in range(500):
            at += rng.choice([0, 1, 2, 9, 30])
            full = sum(b > at for b in begins) >= room
            if not full:
                begin = max(at, free)
                begins.append(begin)
                free = begin + service
            rows.append((0, k, at, k))
            want.append(full)
        assert [r[2] for r in steps(U.bounded_queue(room, service), rows)] == want and any(want)


def test_drops_end_and_are_few():
    out = steps(U.falling_drops(5000, 3, 4), [(3, k, 137 * k) for k in range(400)])
    assert max(r[2] for r in out) == 3 and any(not r[3] and r[2] < 3 for r in out)
    back = steps(U.falling_drops(5000, 3, 1), [(3, 0, 10_000), (3, 1, 0)])
    assert back[1][2] == 1  # time ran back: the first drop has ended


def test_grid_begins_anew_with_its_size():
    out = steps(U.persistent_grid(), [(1, 0, 600), (1, 1, 600), (1, 2, 300), (1, 3, 600)])
    count = [sum(r[1] == k for r in out) for k in range(4)]
    assert count[0] == 600 and 1 <= count[1] <= 2 and count[2] == 300 and count[3] == 600


def test_tiles_take_turns():
    rule = U.tile_refresh(4, 50)
    got = steps(rule, [(1, 0, [20, 20, 20, 20]), (1, 1, [60, 1, 1, 1]), (1, 2, [1, 60, 1, 1]), (1, 3, [1, 1, 1, 1])])
    # the third tile passes the budget; the next frame begins with the fourth and stops after the first, which costs 60
    assert [(f, t) for _, f, _, t, _ in got] == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 0), (2, 1), (3, 2), (3, 3), (3, 0), (3, 1)]
    assert [s for *_, s in got][:5] == [20, 40, 60, 1, 61]
    everything = steps(U.tile_refresh(3, -1), [(1, 0, [1000, 1, 1]), (1, 1, [1, 1, 1])])
    assert [t for *_, t, _ in everything] == [0, 1, 2, 0, 1, 2]


def test_stream_equals_table(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k % 3, k, k * 10 - rng.choice([0, 0, 400])) for k in range(200)], "video long, event_id long, ms long")
    table = sorted(map(tuple, U.over_table(rows, U.NOT_LATE).collect()))
    for slices in (1, 4):
        assert sorted(map(tuple, S.run(rows, "event_id", lambda s: U.over_stream(s, U.NOT_LATE), slices).collect())) == table
    assert 0 < len(table) < 200


def test_empty_stream(spark):
    rows = spark.createDataFrame([], "video long, event_id long, ms long")
    assert S.run(rows, "event_id", lambda s: U.over_stream(s, U.NOT_LATE)).count() == 0
    assert U.over_table(rows, U.NOT_LATE).count() == 0
    assert S.run_latest(rows.withColumn("x", F.lit(1)), "event_id", ["video"]).count() == 0


def test_all_slices_are_read(spark, monkeypatch):
    """A stream that says too early that all is processed loses no slice; one without rows shifts no number."""
    from pyspark.sql.streaming import StreamingQuery

    monkeypatch.setattr(StreamingQuery, "processAllAvailable", lambda query: None)
    rows = [(k % 2, k, k * 10) for k in [*range(5), *range(21, 30)]]  # none of the second slice
    found = S.run_latest(spark.createDataFrame(rows, "video long, event_id long, ms long"), "event_id", ["video"])
    assert sorted(map(tuple, found.collect())) == [(0, 0, 4, 40), (0, 1, 3, 30), (2, 0, 28, 280), (2, 1, 29, 290)]


def test_keys_share_a_call_and_a_state(spark):
    """Few buckets for many keys: states of lists, results in several tables, large keys and none beside each other."""
    rows = spark.createDataFrame([(k % 51 or None, k // 51, 600 if k < 255 else 300) for k in range(510)], "video long, frame long, n_cells long").filter("video IS NOT NULL")
    table = sorted(map(tuple, U.over_table(rows, U.persistent_grid()).collect()))
    found = S.run(rows, "frame", lambda s: U.over_stream(s, U.persistent_grid(), buckets=2), 4)
    assert sorted(map(tuple, found.collect())) == table
    late = spark.createDataFrame([(None if k % 5 == 0 else (1 << 60) + k % 5, k, k * 10 - k % 3 * 90) for k in range(100)], "video long, event_id long, ms long")
    got = S.run(late, "event_id", lambda s: U.over_stream(s, U.NOT_LATE, buckets=1), 3).collect()
    want, latest = [], {}
    for r in sorted(late.collect(), key=lambda r: r["event_id"]):
        if latest.get(r["video"], -1000) <= r["ms"]:
            want.append(tuple(r))
            latest[r["video"]] = r["ms"]
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want and len(want) < 100
