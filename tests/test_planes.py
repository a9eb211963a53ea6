"""Kernels of whole frames: discs by sliding histograms against plain counting, and what they hold."""

import tracemalloc

import numpy as np

from framewright.operators import planes as P


def plain_modes(code, radius, margin):
    out = np.empty_like(radius)
    for y in range(radius.shape[0]):
        for x in range(radius.shape[1]):
            r = radius[y, x]
            seen = [code[y + margin + dy, x + margin + dx] for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r]
            names, counts = np.unique([c for c in seen if c >= 0], return_counts=True)
            out[y, x] = names[counts.argmax()]
    return out


def test_disc_modes(monkeypatch):
    rng = np.random.default_rng(1)
    for limit in (P.MOST_COUNTS, 60):  # whole, and in tiles
        monkeypatch.setattr(P, "MOST_COUNTS", limit)
        for h, w, brush in ((1, 1, 3), (5, 40, 4), (33, 21, 5)):
            code = np.pad(rng.integers(0, 6, (h, w)) * 7, brush, constant_values=-1)
            radius = rng.integers(1, brush + 1, (h, w))
            assert (P.disc_modes(code, radius, brush) == plain_modes(code, radius, brush)).all()


def test_oil_at_full_size_stays_small():
    """The largest frame and brush: far below the stack of all discs, which would take some gigabytes."""
    rng = np.random.default_rng(2)
    y, x = np.mgrid[:405, :720]
    luma = (y // 7 * 3 + x // 5 + rng.integers(0, 12, (405, 720))) % 256
    tracemalloc.start()
    out = P.oil_mode((luma, (x // 3) % 256, (y // 3) % 256), brush=15)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.shape == (3, 405, 720) and most < 200e6, most


def test_seeds_of_uneven_rows():
    """Against all pairs, with ties, empty rows and none at all."""
    from framewright.operators import segments as S

    rng = np.random.default_rng(4)
    for width, height, spacing, most in ((1, 1, 1, 1), (40, 25, 8, 4), (33, 50, 7, 2), (60, 9, 3, 12), (20, 40, 5, 0)):
        for _ in range(4):
            row = np.sort(np.repeat(np.arange(-(-height // spacing)), rng.integers(0, most + 1, -(-height // spacing))))
            sx = rng.integers(0, width, len(row))
            sy = np.minimum(height - 1, row * spacing + rng.integers(0, spacing, len(row)))
            got = S.nearest_of_rows(width, height, spacing, row, sx, sy)
            if not len(row):
                assert (got == -1).all()
                continue
            y, x = np.mgrid[:height, :width]
            d = (x[..., None] - sx) ** 2 + (y[..., None] - sy) ** 2
            assert (got == d.argmin(-1)).all()


def test_results_leave_in_small_batches(monkeypatch):
    """A batch of many frames isn't answered by one as large: results go on once they have so many bytes."""
    import pyarrow as pa

    class Planes:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(P, "OUT_BYTES", 50, raising=False)
    frames = pa.RecordBatch.from_pydict({"frame_id": range(7), "width": [2] * 7, "height": [2] * 7, "yp": [bytes([k] * 4) for k in range(7)], "up": [b"a"] * 7, "vp": [b"b"] * 7})
    got = list(P.apply(Planes(), lambda planes: np.stack([planes[0]] * 3))(iter([frames, frames.slice(0, 0), frames.slice(0, 5)])))
    assert [b.num_rows for b in got] == [5, 2, 5]
    assert [b["frame_id"].to_pylist() for b in got] == [[0, 1, 2, 3, 4], [5, 6], [0, 1, 2, 3, 4]]
    assert got[1]["rgb"].to_pylist() == [bytes([k] * 12) for k in (5, 6)]


def test_stained_glass_stays_in_its_partitions(spark):
    """As the kernel, for borders of any thickness; frames are put together once, and no pixel is sent to a lambda or to a join."""
    from framewright.operators import segments as S

    rng, width, height = np.random.default_rng(6), 21, 14
    planes = [rng.integers(0, 256, (height, width)) for _ in range(3)]
    rows = [(f, x, y, *(int(p[y, x]) for p in planes)) for f in range(2) for y in range(height) for x in range(width)]
    px = spark.createDataFrame(rows, "frame_id long, x int, y int, yy int, uu int, vv int").repartition("frame_id")
    for spacing, thickness in ((4, 1), (6, 3)):
        found = S.stained_glass(px, width, height, spacing, thickness, (20, 30, 40))
        want = P.stained_glass(tuple(planes), spacing, thickness)
        got = found.collect()
        assert len(got) == 2 * width * height
        assert all((r["r"], r["g"], r["b"]) == tuple(want[:, r["y"], r["x"]]) for r in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "lambda" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_segments_are_worked_out_once_for_a_size():
    first = P.segment_map(40, 25, 8)
    assert P.segment_map(40, 25, 8) is first and P.segment_map(40, 25, 6) is not first
