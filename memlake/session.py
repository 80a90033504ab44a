"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

# Used only where no spark.checkpoint.dir is set and the master is local (tests).
_local_folders: dict[str, str] = {}
# Folders given out, by application.
_made: dict[str, list[str]] = {}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app_name: str = "memlake") -> SparkSession.Builder:
    made = SparkSession.builder.appName(app_name)
    for key, value in DEFAULTS.items():
        made = made.config(key, value)
    return made


def workspace(spark: SparkSession) -> str:
    """Folder for tables that cut lineage; it must outlive any executor."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="memlake-")
    return _local_folders[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{workspace(spark)}/memlake/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; empty if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in system.listStatus(where)) if system.exists(where) else []


def first_file(spark: SparkSession, path: str) -> str | None:
    """A data file anywhere below a folder, or None; of each folder on the way the entries are read up to the first that leads on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(where)
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        file = first_file(spark, status.getPath().toString()) if status.isDirectory() else status.getPath().toString()
        if file:
            return file
    return None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; one that is missing is no fault."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables made by this application; results not yet stored are lost with them."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later stages do not depend on
    the executors (or on the nondeterministic split) that produced it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*tasks: Callable[[], object]) -> list:
    """Run independent Spark actions at a time, so that short jobs don't wait for each other's last task; the first failure is raised."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [running.result() for running in [pool.submit(task) for task in tasks]]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settled(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, list[dict] | None]:
    """``df`` computed once: as literal rows if there are at most ``rows`` (then the
    rows are returned too), else as a written table. Either way Spark knows its size."""
    taken = df.limit(rows + 1).toArrow()
    if taken.num_rows <= rows:
        return df.sparkSession.createDataFrame(taken, df.schema), taken.to_pylist()
    return durable(df, name), None


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a small input that one or a few tasks would read.

    Inputs with at least as many splits as cores are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
