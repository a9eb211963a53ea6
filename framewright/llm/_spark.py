"""What the operators share on the Spark side: the shared folder, staged tables, ranks and joins on hot keys."""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a few values each that may be broadcast: some tens of megabytes at most.
MOST_BROADCAST = 200_000
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own where it is unset and all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = tempfile.mkdtemp(prefix="framewright-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back, which cuts its lineage for good."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession) -> SparkSession:
    """Lets Arrow batches of texts take some megabytes, so that long texts don't add up in a task's memory."""
    limit = 8 << 20
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", limit)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    return spark


def passed(column: pa.Array) -> pa.Array:
    """A column to be given back as it came. One that is all null is made anew, as Spark's reader refuses its own form of it."""
    return pa.nulls(len(column), column.type) if column.null_count == len(column) else column


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a worker gives free memory back: it lives on for other stages, beside which it would hold the most it ever had."""

    def then(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)

    return then


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
        pass


def release(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        mine = [x for x in _STAGED if path.endswith(x[1].rsplit("/", 1)[1])]
        for one in mine:
            _STAGED.remove(one)
            _delete(*one)


@atexit.register
def remove_staged() -> None:
    """Deletes the staged tables. Results that still read them must have been written before."""
    while _STAGED:
        _delete(*_STAGED.pop())


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df clashes with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The type by which Arrow knows a column."""
    return to_arrow_type(df.schema[column].dataType)


def gathered(df: DataFrame, splits: int = 8) -> DataFrame:
    """df in fewer tasks, for those that give back a table of fixed size: up to ``splits`` of its partitions each, whatever their number."""
    n = df.rdd.getNumPartitions()
    return df.coalesce(max(1, min(n, df.sparkSession.sparkContext.defaultParallelism), n // splits))


def small(df: DataFrame, n: int) -> DataFrame:
    """df, a table of n rows, with a hint to broadcast it if these are few; else Spark joins it as it finds best."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def least_row(df: DataFrame, keys: list[str], also: dict[str, Column]) -> DataFrame:
    """One row for each group of equal keys, with all columns of df: that of the least JSON form, whatever the partitions; and ``also``, aggregates."""
    own = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(own, F.to_json(own)).alias("__row"), *[c.alias(n) for n, c in also.items()])
    return best.select("__row.*", *also)


def cells(n: int, per: int) -> int:
    """How many cells hold about ``per`` rows each."""
    return max(1, -(-int(n) // per))


def positions(df: DataFrame, group: list[Column], order: list[Column], spread: Column, n_cells: int, weight: Column | None = None) -> DataFrame:
    """Adds ``position``, 0-based and gapless in each group, and ``weight_before``, the sum of weight before a row.

    The order within a group is by cell = spread modulo n_cells, then by ``order``. No task sees a whole group:
    each cell of a group is ranked alone, and the cells' totals (one row each) are summed up beside, in runs of cells and over these.
    """
    from pyspark.sql import Window as W

    names = [f"__g{k}" for k in range(len(group))]
    df = df.withColumns(dict(zip(names, group)) | {"__cell": F.pmod(spread, F.lit(n_cells)).cast("int"), "__w": F.lit(1).cast("long") if weight is None else weight.cast("long")})
    # the cells of a group are ranged over by number; null-safe keys through a hash, which keeps nulls apart from values
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names], *[F.col(c).isNull() for c in names])
    df = df.withColumn("__key", key)
    totals = df.groupBy("__key", "__cell").agg(F.count(F.lit(1)).alias("__n"), F.sum("__w").alias("__s")).withColumn("__run", F.floor(F.col("__cell") / max(1, math.isqrt(n_cells))))
    sums = lambda c, by, at: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = totals.groupBy("__key", "__run").agg(F.sum("__n").alias("__n"), F.sum("__s").alias("__s"))
    runs = runs.select("__key", "__run", sums("__n", ["__key"], "__run").alias("__n1"), sums("__s", ["__key"], "__run").alias("__s1"))
    before = lambda c: sums(c, ["__key", "__run"], "__cell")
    totals = totals.select("__key", "__cell", "__run", before("__n").alias("__n0"), before("__s").alias("__s0")).join(runs, ["__key", "__run"])
    totals = totals.select("__key", "__cell", (F.col("__n0") + F.col("__n1")).alias("__n0"), (F.col("__s0") + F.col("__s1")).alias("__s0"))
    inside = W.partitionBy("__key", "__cell").orderBy(*order)
    ranked = df.withColumns({"__i": F.row_number().over(inside) - 1, "__sw": F.sum("__w").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("__w")})
    out = ranked.join(totals, ["__key", "__cell"])
    return out.withColumns({"position": F.col("__n0") + F.col("__i"), "weight_before": F.col("__s0") + F.col("__sw")}).drop("__key", "__cell", "__w", "__i", "__sw", "__n0", "__s0", *names)
