"""Provenance of memory entries, and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.times import day_of
from memlake.operators.filters import time_range
from memlake.operators.ranking import skewed_join

# Code points kept of a written and of an edited text in the log.
WRITE_DETAIL_CHARS = 100
EDIT_DETAIL_CHARS = 50


def trace_sources(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every entry, once, with whether its source session exists in its own profile, and where it is.

    Another profile's session of the same id is not the source. Many entries may name one session, whose
    rows Spark then splits; entries without a source do not take part in the join.
    """
    key = ["profile_id", "source_session"]
    sourced = entries.where(F.col("source_session").isNotNull())
    known = sessions.groupBy("profile_id", F.col("session_id").alias("source_session")).agg(
        F.min("file_path").alias("session_file_path"), F.lit(True).alias("found")
    )
    # Only sessions that an entry names take part.
    named = known.join(sourced.select(*key).distinct(), key, "left_semi")
    joined = skewed_join(sourced, named, key, "left")
    columns = [*entries.columns]
    traced = joined.select(*columns, F.coalesce("found", F.lit(False)).alias("session_exists"), "session_file_path")
    unsourced = entries.where(F.col("source_session").isNull()).select(
        *columns, F.lit(False).alias("session_exists"), F.lit(None).cast("string").alias("session_file_path")
    )
    return traced.unionByName(unsourced)


def provenance_report(traced: DataFrame, by: list[str] | None = None) -> DataFrame:
    sourced = F.col("source_session").isNotNull()
    return traced.groupBy(*(by or ["target"])).agg(
        F.count("*").alias("total"),
        F.count_if(sourced & F.col("session_exists")).alias("verified"),
        F.count_if(sourced & ~F.col("session_exists")).alias("missing_source"),
        F.count_if(~sourced).alias("no_source"),
    )


def audit_detail(op: Column, old_text: Column, new_text: Column) -> Column:
    """Short JSON about an action; texts are cut by code points."""

    def cut(text: Column, chars: int) -> Column:
        return F.substring(text, 1, chars)

    written = F.to_json(F.struct(cut(new_text, WRITE_DETAIL_CHARS).alias("content_preview")))
    updated = F.to_json(F.struct(cut(old_text, EDIT_DETAIL_CHARS).alias("old"), cut(new_text, EDIT_DETAIL_CHARS).alias("new")))
    removed = F.to_json(F.struct(cut(old_text, EDIT_DETAIL_CHARS).alias("removed")))
    return F.when(op == "write", written).when(op == "update", updated).when(op == "remove", removed)


def audit_events(actions: DataFrame) -> DataFrame:
    """One log row per accepted action.

    actions: timestamp_ms, op, target, old_text, new_text, session_id, verdict.
    """
    accepted = actions.where(F.col("verdict") == "accepted")
    detail = audit_detail(F.col("op"), F.col("old_text"), F.col("new_text"))
    return accepted.select(
        "timestamp_ms", F.col("op").alias("action"), "target", detail.alias("detail"), "session_id"
    )


def write_audit(log: DataFrame, path: str, mode: str = "append") -> None:
    """Store log rows by day, sorted by time: a range reads its days' folders and row groups only."""
    dated = log.withColumn("day", day_of(F.col("timestamp_ms")))
    placed = dated.hint("rebalance", "day").sortWithinPartitions("day", "timestamp_ms")
    placed.write.partitionBy("day").mode(mode).parquet(path)


def read_audit(spark: SparkSession, path: str, after_ms: int | None = None, before_ms: int | None = None) -> DataFrame:
    """Rows of a stored log in a range of time."""
    log = spark.read.parquet(path)
    day = F.col("day").cast("string")
    if after_ms is not None:
        log = log.where(day >= day_of(F.lit(after_ms)))
    if before_ms is not None:
        log = log.where(day <= day_of(F.lit(before_ms)))
    return audit_range(log.drop("day"), after_ms, before_ms)


def event_actions(verdicts: DataFrame) -> DataFrame:
    """Verdicts of replayed events as input of ``audit_events``."""
    return verdicts.withColumnsRenamed({"ts": "timestamp_ms", "source_session": "session_id"})


def audit_range(audit: DataFrame, after_ms: int | None = None, before_ms: int | None = None) -> DataFrame:
    return time_range(audit, after_ms, before_ms)
