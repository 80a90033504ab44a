"""Top-k, running counts and joins that hold when one key owns much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.session import durable, shuffle_width

SALTS = 16
# Rows sorted by one task.
SLICE_ROWS = 5_000_000
# Rows of one group that may meet in one task before a salted round comes first.
GROUP_ROWS = 1_000_000

# Up to this k Spark itself cuts each partition to k rows per group before the shuffle.
_PRUNED_K = 1000


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group, with their 1-based rank.

    Small ``k``: the rank filter is applied on the map side too, so a hot group
    sends at most ``k`` rows per task. Larger ``k``, or so many cores that these rows
    are too many for one task: a salted round comes first.
    """
    if k > _PRUNED_K or k * df.sparkSession.sparkContext.defaultParallelism > GROUP_ROWS:
        df = _salted_round(df, by, order, F.lit(k))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= k)


def top_by_quota(df: DataFrame, by: list[str], order: list[Column], quota: Column, most: int) -> DataFrame:
    """The first ``quota`` rows of every group, where the quota depends on the group
    and is nowhere above ``most``."""
    if most > _PRUNED_K:
        df = _salted_round(df, by, order, quota)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = df.withColumn("_place", place)
    return ranked.where((F.col("_place") <= most) & (F.col("_place") <= quota)).drop("_place")


def _salted_round(df: DataFrame, by: list[str], order: list[Column], quota: Column) -> DataFrame:
    salts = max(SALTS, shuffle_width(df.sparkSession))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(salts)))
    place = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    return salted.withColumn("_place", place).where(F.col("_place") <= quota).drop("_place", "_salt")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "variant")]


def skewed_join(large: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join in which a key may own much of ``large``; ``small`` holds few rows per key.

    Spark measures the shuffled sides and cuts a large partition over as many tasks as its size
    asks for (inner, left and left-semi joins; the sizes are session settings). Where that is switched off,
    every key is spread over ``SALTS`` tasks and ``small`` repeated as often.
    """
    conf = large.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{name}") == "true" for name in ("enabled", "skewJoin.enabled")):
        return large.join(small, on, how)
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(large)), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def running_counts(df: DataFrame, keys: list[str], order: list[str], flags: dict[str, Column]) -> DataFrame:
    """For every row, how many rows of its group up to and including it meet each flag.

    Exact, and no group has to fit one task: rows are range-partitioned, counted
    per slice, and each slice starts from the sum of the slices before it.
    """
    names = list(flags)
    placed = durable(df.select("*", *[flag.cast("long").alias(f"_flag_{name}") for name, flag in flags.items()]), "flagged")
    # The number of written rows is read from file footers.
    slices = max(shuffle_width(df.sparkSession), -(-placed.count() // SLICE_ROWS))
    placed = placed.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    placed = durable(placed, "slices")

    totals = placed.groupBy(*keys, "_slice").agg(*[F.sum(f"_flag_{n}").alias(f"_total_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in names]
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.join(starts, [*keys, "_slice"])
    return counted.select(
        *df.columns, *[(F.col(f"_start_{n}") + F.sum(f"_flag_{n}").over(within)).alias(n) for n in names]
    )


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Dense 1-based numbers over the whole table, without a one-task window."""
    whole = df.withColumn("_all", F.lit(0))
    return running_counts(whole, ["_all"], order, {name: F.lit(1)}).drop("_all")


