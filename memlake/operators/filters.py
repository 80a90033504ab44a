"""Row filters and projections on turns, sessions and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.times import days_before


def time_condition(
    after_ms: int | None = None, before_ms: int | None = None, column: str = "timestamp_ms"
) -> Column | None:
    """Both bounds are inclusive, each is optional."""
    parts = []
    if after_ms is not None:
        parts.append(F.col(column) >= F.lit(after_ms))
    if before_ms is not None:
        parts.append(F.col(column) <= F.lit(before_ms))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def time_range(
    df: DataFrame, after_ms: int | None = None, before_ms: int | None = None, column: str = "timestamp_ms"
) -> DataFrame:
    condition = time_condition(after_ms, before_ms, column)
    return df if condition is None else df.where(condition)


def last_days(df: DataFrame, days: int, now_ms: int, column: str = "timestamp_ms") -> DataFrame:
    return df.where(F.col(column) >= F.lit(days_before(now_ms, days)))


def role_filter(df: DataFrame, role: str) -> DataFrame:
    return df.where(F.col("role") == role)


def by_session(df: DataFrame, session_ids: DataFrame | list[str], profile: str | None = None) -> DataFrame:
    """Rows of some sessions: a frame of (profile_id, session_id), or ids of one ``profile``.

    Two profiles may use the same session id, so an id alone names no session of a table with profiles.
    """
    profiled = "profile_id" in df.columns
    if profile is not None and profiled:
        df = df.where(F.col("profile_id") == profile)
    if not isinstance(session_ids, DataFrame):
        if profiled and profile is None:
            raise ValueError("name the profile of the sessions")
        return df.where(F.col("session_id").isin(session_ids))
    keys = [c for c in ("profile_id", "session_id") if c in session_ids.columns and c in df.columns]
    if profiled and profile is None and "profile_id" not in keys:
        raise ValueError("name the profiles of the sessions")
    return df.join(session_ids.select(*keys).distinct(), keys, "left_semi")


def non_null_preview(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("preview").isNotNull())


def containing(df: DataFrame, text: str, column: str = "content") -> DataFrame:
    return df.where(F.col(column).contains(text))


def lookup_turns(turns: DataFrame, turn_ids: list[int]) -> DataFrame:
    """The turns of a few ids. A scan of a store's turns skips the row groups whose Bloom filter knows none of them."""
    return turns.where(F.col("turn_id").isin(turn_ids))


def hit_context(hits: DataFrame, turns: DataFrame, text: str = "preview") -> DataFrame:
    """Add session, time, role and preview to hits; hits without a turn are dropped."""
    context = turns.select("turn_id", F.col(text).alias("preview"), "session_id", "timestamp_ms", "role")
    return hits.join(context, "turn_id")
