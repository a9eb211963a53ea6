"""Rules over a stream whose keys come to an end: state that goes when a key has been idle, by event time.

The rules are those of rules.py; Spark's keyed state holds what a rule carries, and a timer for each key. When the watermark passes a key's last
frame by the idle time, the state is dropped, so what a long stream holds is the keys of the last while. A timer isn't moved with each batch: one that fires early is
set anew. Rows that come later than the watermark allows are dropped by Spark before the rule sees them. A key that comes back begins anew.

A key costs one reading and one writing of its state in a batch, and rows go as rows, not as a table for each key: streams of many keys with few rows each take that form's time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import by_value
from .rules import Rule

#: Keyed state with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AT_MS = "at_ms__"


class RuleProcessor(StatefulProcessor):
    """A rule's steps over the rows of a key; AT_MS is the column of event time, in the rows beside the rule's."""

    def __init__(self, rule: Rule, idle_ms: int):
        self.rule, self.idle = rule, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"{self.rule.state}, ends long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fields, order = self.rule.fields, [self.rule.fields.index(c) for c in self.rule.order]
        held, batch, ends = self.held.get(), [], None
        for row in rows:
            batch.append(tuple(row[f] for f in fields))
            ends = row[AT_MS] + self.idle if ends is None else max(ends, row[AT_MS] + self.idle)
        batch.sort(key=lambda r: [r[k] for k in order])
        state, out = self.rule.start if held is None else tuple(held)[:-1], []
        for row in batch:
            state, more = self.rule.step(tuple(state), row)
            out += more
        if held is None:
            self.handle.registerTimer(ends)
        else:
            ends = max(ends, held[-1])
        self.held.update((*state, ends))
        named = Row(*self.rule.names)
        for row in out:
            yield named(*row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held is not None and held[-1] > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(held[-1])
        else:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def over_ending_stream(rows: DataFrame, rule: Rule, at: str, late: str, idle_ms: int) -> DataFrame:
    """The rule's rows, of a stream with a timestamp column ``at``. late: the watermark's delay, as an interval; idle_ms: after how long without rows a key's state goes."""
    use_store(rows.sparkSession)
    timed = rows.withWatermark(at, late).withColumn(AT_MS, F.unix_millis(at))
    own = timed.select(*dict.fromkeys([*rule.fields, at, AT_MS])).groupBy(rule.fields[0])
    with by_value():
        return own.transformWithState(RuleProcessor(rule, idle_ms), rule.out, "Append", "EventTime")
