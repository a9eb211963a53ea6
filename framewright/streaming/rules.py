"""Rules that carry state along a stream of frames: late frames, a bounded queue, a persistent grid, falling drops and tiles redrawn in turn.

A rule is a step from (state, row) to (state, rows). It runs in two ways that give the same rows: over a table, each key's rows in
order, and over a stream by Spark's keyed state, where a micro-batch's rows are put in order and later ones come in later batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Buckets of a stream's keys; about how many rows a table has that a task hands on.
BUCKETS, OUT_ROWS = 4096, 20_000


@dataclass(frozen=True)
class Rule:
    """columns: those that rows have (named by ``fields``, the key first, then what orders them); state, out: schemas in DDL."""

    fields: tuple[str, ...]
    order: tuple[str, ...]
    state: str
    out: str
    start: tuple
    step: Callable[[tuple, tuple], tuple[tuple, list[tuple]]]

    @property
    def names(self) -> list[str]:
        return [part.split()[0] for part in self.out.split(", ")]


def over_table(rows: DataFrame, rule: Rule) -> DataFrame:
    """The rule's rows. A key is one line of time and so one task's work, which holds the state alone, not the rows."""
    key = rule.fields[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, rule.start
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[0] != now:
                    now, state = row[0], rule.start
                state, more = rule.step(state, row)
                out += more
            yield pd.DataFrame(out, columns=rule.names)

    ordered = rows.select(*rule.fields).repartition(key).sortWithinPartitions(key, *rule.order)
    return ordered.mapInPandas(run, rule.out)


def over_stream(rows: DataFrame, rule: Rule, buckets: int = BUCKETS) -> DataFrame:
    """The rule's rows, of a stream. A key's rows of one micro-batch are sorted; a key's state is all that stays between batches.

    Spark's keyed state is one for each bucket of keys, with the keys' own states in arrays: what a call and a table cost would otherwise be paid for each key in each
    batch. ``buckets`` is fixed for a stream, as its state is kept by them.
    """
    key, order = rule.fields[0], [rule.fields.index(c) for c in rule.order]
    parts = [part.split(" ", 1) for part in rule.state.split(", ")]

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states = dict(zip(held.get[0], zip(*held.get[1:]))) if held.exists else {}
        batch: dict = {}
        for frame in frames:
            for row in frame[list(rule.fields)].itertuples(index=False, name=None):
                batch.setdefault(None if pd.isna(row[0]) else row[0], []).append(row)
        out: list[tuple] = []
        for own, its in batch.items():
            state = states.get(own, rule.start)
            its.sort(key=lambda r: [r[k] for k in order])
            for row in its:
                state, more = rule.step(tuple(state), row)
                out += more
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(dict(zip(rule.names, zip(*out))), columns=rule.names)
                    out = []
            states[own] = tuple(state)
        held.update((list(states), *map(list, zip(*states.values()))))
        yield pd.DataFrame(dict(zip(rule.names, zip(*out))), columns=rule.names)

    kind = rows.schema[key].dataType.simpleString()
    state = ", ".join([f"keys__ array<{kind}>", *(f"{name} array<{of}>" for name, of in parts)])
    # null is a bucket of its own, so that pandas has whole numbers in the others
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    own = rows.select(*rule.fields, bucket.alias("bucket__")).groupBy("bucket__")
    return own.applyInPandasWithState(run, rule.out, state, "append", GroupStateTimeout.NoTimeout)


def tile_refresh(n_tiles: int, budget_ms: int) -> Rule:
    """A grid of tiles redrawn in turn, each frame as many as its time allows: the cursor goes on where the last frame stopped.

    Rows have what each tile costs in their frame, in ms, by tile. A frame draws tiles until their costs have passed the budget or each has been drawn once; one at
    least. Without a budget (a negative one) all are drawn. Gives (video, frame, place, tile, spent_ms) in the order they are drawn. The state is the cursor.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (cursor,), (video, frame, costs) = state, row
        spent, out = 0, []
        while len(out) < n_tiles and (budget_ms < 0 or spent <= budget_ms):
            spent += int(costs[cursor])
            out.append((video, frame, len(out), cursor, spent))
            cursor = (cursor + 1) % n_tiles
        return (cursor,), out

    return Rule(("video", "frame", "costs"), ("frame",), "cursor int", "video long, frame long, place long, tile long, spent_ms long", (0,), step)


def _late(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
    (latest,), (video, event_id, ms) = state, row
    return ((max(latest, ms),), [(video, event_id, ms)] if latest <= ms else [])


#: Frames that aren't older than one of the same key that came before.
NOT_LATE = Rule(("video", "event_id", "ms"), ("event_id",), "latest long", "video long, event_id long, ms long", (-(1 << 62),), _late)


def bounded_queue(room: int, service_ms: int) -> Rule:
    """A queue of so many waiting frames before one that serves a frame in service_ms: a frame that finds it full is lost.

    The state is when the server is free, and when each waiting frame begins to be served.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (free, waiting), (video, frame, ms, _) = state, row
        waiting = [b for b in waiting if b > ms]
        lost = len(waiting) >= room
        if not lost:
            begin = max(int(ms), int(free))
            free, waiting = begin + service_ms, [*waiting, begin] if begin > ms else waiting
        return (int(free), [int(b) for b in waiting]), [(video, frame, lost)]

    return Rule(("video", "frame", "ms", "event_id"), ("ms", "event_id"), "free long, waiting array<long>", "video long, frame long, lost boolean", (-(1 << 62), []), step)


def number(key: int, k: int) -> int:
    """An arithmetic step of (key, k): what stands for a random number, as functions.numbers.jitter() has it."""
    return ((int(key) * 8 + k) * 1103515245 + 12345) % (1 << 31) // 65536


#: One of so many cells changes with each frame; characters that a cell may show.
CHANGE_SHARE, N_CHARS = 300, 64


def grid_value(video: int, cell: int) -> int:
    return number(video * 1009 + cell, 0) % N_CHARS


def persistent_grid(keep: Callable[[int], bool] = lambda frame: True) -> Rule:
    """A grid of characters that stays from frame to frame while some cells change; it begins anew when its size does.

    Rows have the number of cells. Gives (video, frame, cell, value) of the cells that a frame changed, all of them where it begins.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (cells,), (video, frame, n) = state, row
        out = []
        if len(cells) != n:
            cells = [grid_value(video, c) for c in range(n)]
            out = [(video, frame, c, v) for c, v in enumerate(cells)]
        else:
            cells = list(cells)
        changed = {}
        for j in range(n // CHANGE_SHARE):
            seed = video * 1_000_003 + frame * 16 + j
            changed[number(seed, 1) % n] = number(seed, 2) % N_CHARS
        for c, v in changed.items():
            cells[c] = v
        if out:
            out = [(video, frame, c, v) for c, v in enumerate(cells)]
        else:
            out = [(video, frame, c, v) for c, v in changed.items()]
        return ([int(v) for v in cells],), out

    return Rule(("video", "frame", "n_cells"), ("frame",), "cells array<int>", "video long, frame long, cell long, value long", ([],), step)


def falling_drops(ttl_ms: int, most: int, one_in: int) -> Rule:
    """Drops begin with one frame in so many, unless the most are alive, and end after their time or when time runs back.

    Rows have the time of the frame. Gives (video, frame, alive, begun). The state is when each living drop began.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (starts,), (video, frame, ms) = state, row
        alive = [int(s) for s in starts if 0 <= ms - s <= ttl_ms]
        begun = len(alive) < most and number(video * 7919 + frame, 3) % one_in == 0
        if begun:
            alive.append(int(ms))
        return (alive,), [(video, frame, len(alive), begun)]

    return Rule(("video", "frame", "ms"), ("frame",), "starts array<long>", "video long, frame long, alive long, begun boolean", ([],), step)
