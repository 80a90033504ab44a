"""Nested session payloads (one row per session, turns in an array)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PROFILE = "default"
DEFAULT_ROLE = "user"


def sessions_from_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payload rows to headers and turns.

    Input: session_id, turns array<struct<timestamp, role, content, metadata>>, and
    optionally profile, source, title, tags. The sequence is the position, the
    start is the first turn's time, a missing role is ``user``, missing text empty.
    """
    known = set(payloads.columns)

    def optional(name: str, kind: str = "string"):
        return F.col(name) if name in known else F.lit(None).cast(kind)

    start_time = F.coalesce(F.get("turns", F.lit(0))["timestamp"], F.lit("")).alias("start_time")
    profile_id = F.coalesce(optional("profile"), F.lit(DEFAULT_PROFILE)).alias("profile_id")
    headers = payloads.select(
        "session_id",
        start_time,
        profile_id,
        optional("source").alias("source"),
        F.lit(None).cast("string").alias("agent_model"),
        optional("title").alias("title"),
        F.array_compact(F.coalesce(optional("tags", "array<string>"), F.array().cast("array<string>"))).alias("tags"),
    )
    turns = payloads.select("session_id", profile_id, start_time, F.posexplode("turns").alias("i", "t")).select(
        "session_id",
        "profile_id",
        "start_time",
        (F.col("i") + 1).cast("long").alias("pos"),
        F.coalesce("t.timestamp", F.lit("")).alias("ts"),
        (F.col("i") + 1).cast("long").alias("seq"),
        F.coalesce("t.role", F.lit(DEFAULT_ROLE)).alias("role"),
        F.coalesce("t.content", F.lit("")).alias("content"),
        F.col("t.metadata").alias("metadata"),
    )
    return headers, turns
