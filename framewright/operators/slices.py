"""Running values along a line of time that is cut into slices, so that one hot key is many tasks' work.

Rows are put in order over the whole table by range partitions of about equal size, however many of them one key has, and written to the shared folder
with their partition's number, the *slice*. A running value is then one inside a slice and a carry from the slices of the key before it.
The carries come from a row for each key and slice; no task sees more of a key than a slice, or than these rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

SLICE = "slice__"


@dataclass(frozen=True)
class Running:
    """A value over the rows before this one in its key (after it, if ``back``), this one aside; ``value`` null rows don't count.

    kind: count, sum, min, max, or last, that is the nearest row's. A whole one is over all rows of the key.
    """

    kind: str
    value: Column
    back: bool = False
    whole: bool = False

    def over(self, rows: Column) -> Column:
        """The running value of a column that holds the values, or parts of them."""
        return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[self.kind](rows)


def sliced(rows: DataFrame, key: str, order: list[str], slices: int | None = None) -> DataFrame:
    """rows with their slice, written and read back: ranges of (key, order), nulls first, with about as many rows each. Slices follow the order."""
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(n, key, *order).withColumn(SLICE, F.spark_partition_id()))


def running(rows: DataFrame, key: str, order: list[str], values: dict[str, Running]) -> DataFrame:
    """Adds the running values by name to rows of sliced(), which were cut by the same key and order.

    A count or sum before the first row is 0; other values are null there. Rows equal in key and order may take each other's place.
    """
    local = Window.partitionBy(key, SLICE).orderBy(*order)
    ahead = Window.partitionBy(key, SLICE).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    # a video's slices, at most one for each partition
    slices = Window.partitionBy(key).orderBy(SLICE)
    slices_ahead = Window.partitionBy(key).orderBy(F.col(SLICE).desc())
    place = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])

    inside, totals, carried, out = {}, [], {}, {}
    for name, r in values.items():
        here, total, carry = f"{name}__here", f"{name}__total", f"{name}__carry"
        before = (ahead if r.back else local).rowsBetween(Window.unboundedPreceding, -1)
        of_slices = slices_ahead if r.back else slices
        up_to = of_slices.rowsBetween(Window.unboundedPreceding, -1) if not r.whole else Window.partitionBy(key)
        value = F.when(r.value.isNotNull(), 1).otherwise(0).cast("long") if r.kind == "count" else r.value
        if r.kind == "last":
            totals.append((F.min_by if r.back else F.max_by)(F.when(r.value.isNotNull(), r.value), F.when(r.value.isNotNull(), place)).alias(total))
            inside[here] = F.last(r.value, ignorenulls=True).over(before)
            carried[carry] = F.last(total, ignorenulls=True).over(up_to)
            out[name] = F.coalesce(here, carry)
            continue
        totals.append(r.over(value).alias(total))
        carried[carry] = r.over(F.col(total)).over(up_to)
        if r.whole:
            out[name] = F.col(carry)
            continue
        inside[here] = r.over(value).over(before)
        if r.kind in ("count", "sum"):
            out[name] = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        else:
            out[name] = (F.least if r.kind == "min" else F.greatest)(here, carry)  # nulls are passed over
    carries = rows.groupBy(key, SLICE).agg(*totals).select(key, SLICE, *[c.alias(n) for n, c in carried.items()])
    carries = carries.withColumnsRenamed({key: "key__", SLICE: "its_slice__"})
    both = rows.withColumns(inside).join(carries, F.col(key).eqNullSafe(F.col("key__")) & (F.col(SLICE) == F.col("its_slice__")))
    return both.select(*rows.columns, *[c.alias(n) for n, c in out.items()])
