"""Listings, exports, statistics and consistency reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.times import to_iso
from memlake.operators.filters import by_session, last_days
from memlake.operators.ingest import SESSION_KEY


def list_sessions(
    sessions: DataFrame, limit: int, days: int | None = None, now_ms: int | None = None, profile: str | None = None
) -> DataFrame:
    """The latest sessions, of one profile or all. ``days`` keeps those that started in the last days before ``now_ms``."""
    if profile is not None:
        sessions = sessions.where(F.col("profile_id") == profile)
    if days is not None:
        if now_ms is None:
            raise ValueError("days needs now_ms")
        sessions = last_days(sessions, days, now_ms, "start_ts")
    latest = sessions.orderBy(F.col("start_ts").desc(), F.col("session_id").asc(), F.col("profile_id").asc()).limit(limit)
    return latest.select("session_id", "start_ts", to_iso(F.col("start_ts")).alias("start_time"), "source", "turn_count", "title")


def export_sessions(sessions: DataFrame, turns: DataFrame, session_ids: DataFrame | list[str], profile: str | None = None) -> DataFrame:
    """Sessions with their own turns in order; ``session_ids`` as of ``by_session``."""
    chosen = by_session(sessions, session_ids, profile).select(
        *SESSION_KEY, "file_path", to_iso(F.col("start_ts")).alias("start_time"), "source", "turn_count"
    )
    lines = turns.select(*SESSION_KEY, "seq", "role", to_iso(F.col("timestamp_ms")).alias("time"), "preview")
    return chosen.join(lines, SESSION_KEY).orderBy(*SESSION_KEY, "seq")


def list_profiles(sessions: DataFrame) -> DataFrame:
    return sessions.select("profile_id").distinct().orderBy("profile_id")


def profile_counts(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions and turns per profile; each side is aggregated before they meet."""
    n_sessions = sessions.groupBy("profile_id").agg(F.count("*").alias("n_sessions"))
    n_turns = turns.groupBy("profile_id").agg(F.count("*").alias("n_turns"))
    joined = n_sessions.join(n_turns, "profile_id", "full_outer")
    return joined.fillna(0, ["n_sessions", "n_turns"])


def index_stats(sessions: DataFrame, turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of the three tables in one row; each table is counted on its own."""
    parts = [
        table.select(*[F.lit(1 if name == own else 0).cast("long").alias(name) for name in ("n_sessions", "n_turns", "n_vectors")])
        for own, table in (("n_sessions", sessions), ("n_turns", turns), ("n_vectors", vectors))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])


def rebuild_stats(sessions: DataFrame, turns: DataFrame, vectors: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters of a rebuild; the errors themselves stay a DataFrame."""
    tables = {"sessions_processed": sessions, "turns_indexed": turns, "vectors_indexed": vectors, "n_errors": errors}
    rows = None
    for own, table in tables.items():
        ones = table.select(*[F.lit(1 if name == own else 0).cast("long").alias(name) for name in tables])
        rows = ones if rows is None else rows.unionByName(ones)
    return rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in tables])


def check_consistency(archive_sessions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Archive against table by profile and session id, not only by count."""
    archived = archive_sessions.select(*SESSION_KEY).distinct().withColumn("archived", F.lit(1))
    stored = sessions.select(*SESSION_KEY).distinct().withColumn("stored", F.lit(1))
    both = archived.join(stored, SESSION_KEY, "full_outer")
    counts = both.agg(
        F.count("archived").alias("archive_count"),
        F.count("stored").alias("session_count"),
        F.count_if(F.col("stored").isNull()).alias("missing_in_index"),
        F.count_if(F.col("archived").isNull()).alias("missing_in_archive"),
    )
    in_sync = (F.col("missing_in_index") == 0) & (F.col("missing_in_archive") == 0)
    return counts.withColumn("in_sync", in_sync)


def index_parity(turns: DataFrame, postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Turns that have no postings or no vector, and index rows without a turn."""
    ids = turns.select("turn_id").withColumn("turn", F.lit(1))
    worded = postings.select("turn_id").distinct().withColumn("posting", F.lit(1))
    placed = vectors.select("turn_id").distinct().withColumn("vector", F.lit(1))
    joined = ids.join(worded, "turn_id", "full_outer").join(placed, "turn_id", "full_outer")
    is_turn = F.col("turn").isNotNull()
    return joined.agg(
        F.count_if(is_turn).alias("n_turns"),
        F.count_if(is_turn & F.col("posting").isNull()).alias("without_postings"),
        F.count_if(is_turn & F.col("vector").isNull()).alias("without_vector"),
        F.count_if(~is_turn).alias("without_turn"),
    )
