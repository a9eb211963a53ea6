"""Sessions, tables and the way this package reaches the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
_STAGED: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors' Python workers, once per Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="framewright-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, f"{PACKAGE.name}/{file.relative_to(PACKAGE)}")
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


@contextlib.contextmanager
def by_value() -> Iterator[None]:
    """What is pickled within goes with its code: the Python processes that plan a read, commit a write or set up a stream's state don't have what ship() gives to tasks."""
    package = sys.modules[PACKAGE.name]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def register(spark: SparkSession, source: type) -> None:
    """Makes a data source of this package known to Spark."""
    with by_value():
        spark.dataSource.register(source)


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and the executors share: that of spark.checkpoint.dir; one of this machine if all run on it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="framewright-")
    return shared_folder.own


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back, which cuts its lineage; the folder goes with the session."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _STAGED.append((df.sparkSession, path))
    return df.sparkSession.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of a file system that Spark reaches; whether it was there doesn't matter."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, which goes with the session."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


@atexit.register
def remove_staged() -> None:
    while _STAGED:
        try:
            delete(*_STAGED.pop())
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("framewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
