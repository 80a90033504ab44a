"""Parquet tables: profile partitions, and an append log where the latest version wins."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.session import exists, first_file, folders, remove, shuffle_width

# Tasks that list the folders of a table.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_listing = threading.Lock()
# Tasks per core that write a table of many folders.
RANGES_PER_CORE = 4


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored table, or some of its columns; a profile column is text."""
    table = read_by_profile(spark, path)
    return table.select(*columns) if columns else table


def write_by_profile(
    df: DataFrame, path: str, cluster_by: list[str], mode: str = "overwrite", by: tuple[str, ...] = ("profile_id",),
    touched_only: bool = False, counted: Observation | None = None, lookup: str | None = None, many: bool = False,
) -> None:
    """One folder per profile (or per value of ``by``). Rebalancing splits a large one into tasks and
    files of even size. Within a file rows are sorted, so that filters on
    ``cluster_by`` skip row groups. With ``touched_only`` folders that ``df`` has no rows for stay as they are.
    ``counted`` learns the number of rows (n) as they are written. A ``lookup`` column gets Bloom filters, so that
    scans for single values of it skip row groups. ``many`` folders of few rows take their time for the files, not for
    the bytes, by which Spark would put them together: ranges of folders are dealt to the tasks then.
    """
    placed = _dealt(df, [*by, *cluster_by]) if many else df.hint("rebalance", *by)
    placed = placed.sortWithinPartitions(*by, *cluster_by)
    if counted is not None:
        # Last in the plan: an empty shuffle would take it away with what is below.
        placed = placed.observe(counted, F.count(F.lit(1)).alias("n"))
    writer = placed.write.partitionBy(*by).mode(mode)
    if lookup is not None:
        # Parquet makes no Bloom filter of a column that it has a dictionary for; single values gain nothing from one.
        options = {f"parquet.enable.dictionary#{lookup}": "false", f"parquet.bloom.filter.enabled#{lookup}": "true"}
        writer = writer.options(**options, **{"parquet.bloom.filter.adaptive.enabled": "true"})
    if touched_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """Even ranges, a few for every core; the last key parts rows that are alike in ``order``. To find the ranges
    Spark computes ``df`` one more time."""
    spark = df.sparkSession
    ranges = min(shuffle_width(spark), RANGES_PER_CORE * spark.sparkContext.defaultParallelism)
    rest = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    return df.repartitionByRange(ranges, *order, rest)


def read_by_profile(spark: SparkSession, path: str) -> DataFrame:
    """All profiles. Names of folders are texts, also those that look like numbers or dates."""
    # One file tells the columns; the folders are listed once.
    file = first_file(spark, path)
    found = spark.read.option("basePath", path).parquet(file or path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in ("profile_id", "day") else f for f in found.fields]
    return _listed(spark, T.StructType(fields), path)


def _listed(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """By default a task lists one folder, and tells the driver more of itself than of the folder."""
    with _listing:
        before = spark.conf.get(LISTING_TASKS)
        spark.conf.set(LISTING_TASKS, str(min(int(before), spark.sparkContext.defaultParallelism)))
        try:
            return spark.read.schema(schema).parquet(path)
        finally:
            spark.conf.set(LISTING_TASKS, before)


def read_profile(spark: SparkSession, path: str, profile_id: str) -> DataFrame:
    """One profile's rows; the folder of every other profile is pruned."""
    return read_by_profile(spark, path).where(F.col("profile_id") == profile_id)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch into its own folder; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


# --- logs that are merged while they grow ----------------------------------------------


def log_folders(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) batch of the folders that a reader of a log opens: the largest merged ones, and the batches in none."""
    found = []
    for name in folders(spark, path):
        kind, _, numbers = name.partition("=")
        if kind in ("batch_id", "merged") and exists(spark, f"{path}/{name}/_SUCCESS"):
            first, last = numbers.split("-") if kind == "merged" else (numbers, numbers)
            found.append((int(first), int(last)))
    # Intervals are nested or apart: the longer one comes first among those with one beginning.
    chosen: list[tuple[int, int]] = []
    for first, last in sorted(found, key=lambda x: (x[0], -x[1])):
        if not chosen or last > chosen[-1][1]:
            chosen.append((first, last))
    return chosen


def log_folder(path: str, first: int, last: int) -> str:
    return f"{path}/batch_id={first}" if first == last else f"{path}/merged={first}-{last}"


def read_merged_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log, each batch once."""
    return spark.read.parquet(*[log_folder(path, first, last) for first, last in log_folders(spark, path)])


def due_merge(batch_id: int, every: int) -> int:
    """How many batches up to this one are to be merged: the largest power of ``every`` that ends here, or 0."""
    size = every
    while (batch_id + 1) % (size * every) == 0:
        size *= every
    return size if (batch_id + 1) % size == 0 else 0


def drop_merged(spark: SparkSession, path: str, before: int) -> None:
    """Delete folders that end before a batch and whose rows a larger one holds."""
    chosen = log_folders(spark, path)
    for name in folders(spark, path):
        kind, _, numbers = name.partition("=")
        if kind in ("batch_id", "merged"):
            first, last = map(int, numbers.split("-") if kind == "merged" else (numbers, numbers))
            held = any(a <= first and last <= b and (a, b) != (first, last) for a, b in chosen)
            if held and last < before:
                remove(spark, f"{path}/{name}")
