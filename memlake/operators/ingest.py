"""Turn and session tables: build, replace, purge, number."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import PREVIEW_CHARS, preview
from memlake.functions.times import to_millis
from memlake.operators.ranking import row_numbers

USAGE_SCHEMA = "usage struct<input_tokens: bigint, output_tokens: bigint>"


# A session belongs to a profile; two profiles may use the same session id.
SESSION_KEY = ["profile_id", "session_id"]


def turn_id() -> Column:
    """A key that depends on the row alone, so that a recomputed task agrees.

    A turn is known by its profile, session and place: ``seq`` is what the archive says, and
    may repeat. ``check_turn_ids`` finds the rare pair of turns with the same hash.
    """
    return F.xxhash64(F.col("profile_id"), F.col("session_id"), F.col("pos").cast("long"))


def check_turn_ids(turns: DataFrame) -> None:
    """Raise if two turns share an id."""
    twice = turns.groupBy("turn_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two turns have the id {twice[0]['turn_id']}; number them with assign_turn_ids")


def build_turns(turns: DataFrame, preview_chars: int = PREVIEW_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Archive turns to the ``turns`` table; ``carry`` names further columns to keep.

    A time that cannot be read becomes the session start; sessions without a
    readable start are left out. ``char_count`` counts bytes, ``n_chars`` code points.
    """
    kept = [c for c in carry if c in turns.columns]
    has_start, columns = _turn_columns("turn_id" in turns.columns, preview_chars)
    return turns.where(has_start).select(*columns, *kept)


@functools.cache
def _turn_columns(has_id: bool, preview_chars: int) -> tuple[Column, tuple[Column | str, ...]]:
    """Made once: a stream builds the turns of thousands of small batches."""
    key = F.col("turn_id") if has_id else turn_id()
    start = to_millis(F.col("start_time"))
    return start.isNotNull(), (
        key.alias("turn_id"),
        "session_id",
        "profile_id",
        "seq",
        F.coalesce(to_millis(F.col("ts")), start).alias("timestamp_ms"),
        "role",
        "content",
        preview(F.col("content"), preview_chars).alias("preview"),
        F.octet_length("content").cast("long").alias("char_count"),
        F.char_length("content").cast("long").alias("n_chars"),
    )


def turn_tokens(metadata: Column, mode: str = "lenient") -> Column:
    """Tokens of a turn. ``strict`` needs both counts, ``lenient`` reads a missing one as 0."""
    usage = F.from_json(metadata, USAGE_SCHEMA)["usage"]
    given, made = usage["input_tokens"], usage["output_tokens"]
    if mode == "strict":
        return F.coalesce(given + made, F.lit(0))
    if mode != "lenient":
        raise ValueError(f"unknown token mode: {mode}")
    both = F.coalesce(given, F.lit(0)) + F.coalesce(made, F.lit(0))
    return F.greatest(both, F.lit(0))


def build_sessions(
    headers: DataFrame, turns: DataFrame, now_ms: int, token_mode: str = "lenient", end_fallback: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per session with its start, end, turn count and token sum; ``carry`` names further columns of the headers to keep.

    The end is the time of the last turn in order, not the latest time. Where that
    time cannot be read the end is NULL, or the start with ``end_fallback``.
    """
    rollup = turns.groupBy(*SESSION_KEY).agg(*_rollup_columns(token_mode))
    first_parts = headers.where(F.col("part") == 0) if "part" in headers.columns else headers
    joined = first_parts.join(rollup, SESSION_KEY, "left")
    has_start, columns = _session_columns("file_path" in headers.columns, end_fallback)
    times = [F.lit(now_ms).cast("long").alias(name) for name in ("created_at", "updated_at")]
    return joined.where(has_start).select(*columns, *times, *carry)


@functools.cache
def _rollup_columns(token_mode: str) -> tuple[Column, ...]:
    return (
        F.count("*").alias("turn_count"),
        F.sum(turn_tokens(F.col("metadata"), token_mode)).alias("total_tokens"),
        F.max_by(F.coalesce(to_millis(F.col("ts")), F.lit(-1)), "pos").alias("last_ts"),
    )


@functools.cache
def _session_columns(has_file: bool, end_fallback: bool) -> tuple[Column, tuple[Column | str, ...]]:
    start = to_millis(F.col("start_time"))
    end = F.when(F.col("last_ts") >= 0, F.col("last_ts"))
    if end_fallback:
        end = F.when(F.col("turn_count").isNotNull(), F.coalesce(end, start))
    file_path = F.col("file_path") if has_file else F.lit(None).cast("string")
    return start.isNotNull(), (
        "session_id",
        start.alias("start_ts"),
        end.alias("end_ts"),
        file_path.alias("file_path"),
        "title",
        F.lit(None).cast("string").alias("summary"),
        "profile_id",
        "source",
        "agent_model",
        F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        F.when(F.size("tags") > 0, F.to_json("tags")).alias("tags"),
    )


def latest_version(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The rows of each key's newest version.

    The newest version is found by an aggregate, which is combined before the
    shuffle; the rows themselves are then matched, never gathered per key.
    """
    newest = df.groupBy(*key).agg(F.max(F.struct(*version)).alias("_newest"))
    newest = newest.select(*key, *[F.col("_newest")[v].alias(v) for v in version])
    return df.join(newest, [*key, *version], "left_semi")


def upsert_sessions(stored: DataFrame, incoming: DataFrame, session_ids: DataFrame | None = None) -> DataFrame:
    """Incoming sessions replace the stored ones together with all their rows.

    Works on any table that carries ``profile_id`` and ``session_id``. ``session_ids`` names
    the replaced sessions where some of them bring no rows (a session without turns).
    """
    replaced = (session_ids if session_ids is not None else incoming).select(*SESSION_KEY).distinct()
    return stored.join(replaced, SESSION_KEY, "left_anti").select(*stored.columns).unionByName(incoming)


def keep_created_at(upserted: DataFrame, stored: DataFrame) -> DataFrame:
    """Give replaced sessions the time they were first seen."""
    first = stored.groupBy(*SESSION_KEY).agg(F.min("created_at").alias("first_created"))
    joined = upserted.join(first, SESSION_KEY, "left")
    return joined.withColumn("created_at", F.coalesce("first_created", "created_at")).select(*upserted.columns)


def purge_orphans(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Drop index rows whose turn is gone."""
    return rows.join(turns.select("turn_id"), "turn_id", "left_semi")


def assign_turn_ids(turns: DataFrame) -> DataFrame:
    """Dense ids in order of session, profile and place, numbered without a one-task sort.

    Tables without the place (``pos``) are numbered by ``seq`` instead.
    """
    place = "pos" if "pos" in turns.columns else "seq"
    return row_numbers(turns.drop("turn_id"), ["session_id", "profile_id", place], "turn_id")


def append_vectors(stored: DataFrame, added: DataFrame) -> DataFrame:
    return stored.unionByName(added)


def delete_vectors(stored: DataFrame, turn_ids: DataFrame) -> DataFrame:
    return stored.join(turn_ids.select("turn_id"), "turn_id", "left_anti")


def clear_vectors(stored: DataFrame) -> DataFrame:
    return stored.limit(0)


def count_vectors(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count("*").alias("n_vectors"))
