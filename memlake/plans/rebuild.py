"""Rebuild every derived table from an archive, or save new sessions into them.

Turns, sessions and vectors lie in folders by profile and day (of the session's start). A save writes the folders
anew that it takes sessions from or brings some to, and appends a segment to the index. What it will
write is staged first: a save that was cut short is carried out by the next one, or by ``finish_save``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from memlake.functions.times import day_of, to_millis
from memlake.operators.ingest import (
    SESSION_KEY,
    append_vectors,
    build_sessions,
    build_turns,
    check_turn_ids,
    delete_vectors,
    keep_created_at,
    latest_version,
    upsert_sessions,
)
from memlake.operators.keyword import TERM_BUCKETS, KeywordIndex, append_segment, build_index, next_segment
from memlake.operators.vector import embed_texts, quantized
from memlake.session import durable, exists, remove, settled, together
from memlake.sources.archive import Archive, archive_of, parsed_lines, read_lines
from memlake.sources.tables import read_by_profile, write_by_profile

CARRIED = ("profile_id", "timestamp_ms", "role")
VERSION = ["version", "version_file"]
# The folders of a store's tables, what single rows are looked up by, and what rows are sorted by.
FOLDER = ("profile_id", "day")
LOOKUP = {"turns": "turn_id"}
TABLES = {"turns": "timestamp_ms", "sessions": "start_ts", "vectors": "timestamp_ms"}
# Up to this number of touched folders the scans are told which they are.
LITERAL_FOLDERS = 1_000


@dataclass(frozen=True)
class Store:
    """The derived tables below one folder."""

    path: str

    def sessions(self, spark: SparkSession) -> DataFrame:
        return read_by_profile(spark, f"{self.path}/sessions")

    def turns(self, spark: SparkSession) -> DataFrame:
        return read_by_profile(spark, f"{self.path}/turns")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return read_by_profile(spark, f"{self.path}/vectors")

    def errors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/errors").drop("save")

    def index(self, spark: SparkSession, profile: str | None = None) -> KeywordIndex:
        return KeywordIndex.read(spark, self.path, profile)


def newest(archive: Archive) -> Archive:
    """Of two archived versions of a session only the later one."""
    headers = latest_version(archive.headers, SESSION_KEY, VERSION)
    kept = headers.select(*SESSION_KEY, *VERSION).distinct()
    turns = archive.turns.join(kept, [*SESSION_KEY, *VERSION], "left_semi")
    return Archive(headers, turns, archive.errors)


def dated_turns(turns: DataFrame) -> DataFrame:
    """The turns table with the day of the session's start."""
    return build_turns(turns.withColumn("day", day_of(to_millis(F.col("start_time")))), carry=("day",))


def dated_sessions(headers: DataFrame, turns: DataFrame, now_ms: int) -> DataFrame:
    return build_sessions(headers, turns, now_ms).withColumn("day", day_of(F.col("start_ts")))


def rebuild_index(
    spark: SparkSession,
    archive_path: str,
    store_path: str,
    now_ms: int,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    text: str = "content",
    with_vectors: bool = True,
    buckets: int = TERM_BUCKETS,
) -> DataFrame:
    """Read the archive once, then derive everything from written tables; returns
    one row of counters, taken while the tables are written.

    ``store_path`` must be a new folder: a table is never overwritten by a plan
    that reads it. ``buckets`` should grow with the corpus.
    """
    archive = newest(archive_of(durable(parsed_lines(read_lines(spark, archive_path)), "archive-lines")))
    store = Store(store_path)
    names = ("sessions_processed", "turns_indexed", "vectors_indexed", "n_errors")
    counts = {name: Observation(name) for name in names}

    def put(table: str, name: str, rows: DataFrame) -> None:
        write_by_profile(rows, f"{store_path}/{table}", [TABLES[table]], by=FOLDER, counted=counts[name], lookup=LOOKUP.get(table), many=True)

    errors = archive.errors.observe(counts["n_errors"], F.count(F.lit(1)).alias("n"))
    together(
        lambda: put("turns", "turns_indexed", dated_turns(archive.turns)),
        lambda: put("sessions", "sessions_processed", dated_sessions(archive.headers, archive.turns, now_ms)),
        lambda: errors.write.parquet(f"{store_path}/errors/save=0"),
    )
    turns = store.turns(spark)
    indexed = turns if with_vectors else turns.limit(0)
    together(
        lambda: check_turn_ids(turns),
        lambda: build_index(turns, text, CARRIED, buckets).write(store_path),
        lambda: put("vectors", "vectors_indexed", durable(build_vectors(indexed, load_encoder, text), "vectors")),
    )
    return spark.createDataFrame([tuple(counts[name].get["n"] for name in names)], ", ".join(f"{name} long" for name in names))


def save_sessions(
    spark: SparkSession,
    store: Store,
    archive: Archive,
    now_ms: int,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    text: str = "content",
    with_vectors: bool = True,
) -> Store:
    """Save the sessions of ``archive`` into a store.

    A saved session replaces the stored one of its profile and id with all its turns, postings
    and vectors, and keeps the time it was first seen. Of several versions in ``archive`` the newest
    counts. Written are the touched folders of each table and one segment of the index. One save at a time:
    frames read from the store before it must be read again after it.
    """
    finish_save(spark, store)
    archive = newest(archive)
    headers, incoming = together(lambda: durable(archive.headers, "saved-headers"), lambda: durable(archive.turns, "saved-turns"))
    replaced = headers.select(*SESSION_KEY).distinct()
    pending = f"{store.path}/pending"

    def stage(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{pending}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{pending}/{name}")

    added, sessions = together(
        lambda: stage("added", dated_turns(incoming)), lambda: durable(dated_sessions(headers, incoming, now_ms), "added-sessions")
    )
    all_turns, all_sessions = together(lambda: store.turns(spark), lambda: store.sessions(spark))
    held = all_sessions.join(replaced, SESSION_KEY, "left_semi").select(*FOLDER)
    touched, rows = settled(held.unionByName(sessions.select(*FOLDER)).distinct(), LITERAL_FOLDERS, "touched-folders")

    def stored(table: DataFrame) -> DataFrame:
        return table.join(touched, [*FOLDER], "left_semi") if rows is None else table.where(_in_folders(rows))

    old_turns, old_sessions = stored(all_turns), stored(all_sessions)
    gone, _ = together(
        lambda: stage("gone", old_turns.join(replaced, SESSION_KEY, "left_semi").select(*old_turns.columns)), lambda: _check_new_ids(all_turns, added)
    )
    new_vectors = build_vectors(added if with_vectors else added.limit(0), load_encoder, text)
    together(
        lambda: stage("turns", upsert_sessions(old_turns, added, replaced)),
        lambda: stage("sessions", upsert_sessions(old_sessions, keep_created_at(sessions, old_sessions), replaced)),
        lambda: stage("vectors", append_vectors(delete_vectors(stored(store.vectors(spark)), gone), new_vectors)),
        lambda: stage("touched", touched),
        lambda: stage("errors", archive.errors),
    )
    # Written last: from here on the save will be carried out.
    plan = [(next_segment(spark, store.path), text)]
    spark.createDataFrame(plan, "segment int, text string").coalesce(1).write.parquet(f"{pending}/plan")
    finish_save(spark, store)
    return store


def finish_save(spark: SparkSession, store: Store) -> None:
    """Carry out a staged save, whatever part of it was done before; one that was not wholly staged is given up."""
    pending = f"{store.path}/pending"
    if exists(spark, f"{pending}/plan/_SUCCESS"):
        plan = spark.read.parquet(f"{pending}/plan").first()
        staged = {name: read_by_profile(spark, f"{pending}/{name}") for name in ("gone", "added", "touched", *TABLES)}
        errors = spark.read.parquet(f"{pending}/errors")

        def put(table: str) -> None:
            write_by_profile(staged[table], f"{store.path}/{table}", [TABLES[table]], by=FOLDER, touched_only=True, lookup=LOOKUP.get(table), many=True)
            # Folders that lost all their rows.
            emptied = staged["touched"].join(staged[table].select(*FOLDER).distinct(), [*FOLDER], "left_anti")
            for row in emptied.toLocalIterator():
                remove(spark, _folder(spark, f"{store.path}/{table}", row))

        together(
            lambda: append_segment(store.path, plan["segment"], staged["gone"], staged["added"], plan["text"]),
            lambda: errors.write.mode("overwrite").parquet(f"{store.path}/errors/save={plan['segment']}"),
            *[lambda table=table: put(table) for table in TABLES],
        )
    remove(spark, pending)


def _folder(spark: SparkSession, path: str, row) -> str:
    """Where Spark puts the rows of one folder; names are escaped as it does."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join([path, *(escape(name, row[name]) for name in FOLDER)])


def _in_folders(rows: list[dict]) -> Column:
    """A condition on folder names, for scans to leave out all others."""
    days: dict[str, list[str]] = {}
    for row in rows:
        days.setdefault(row["profile_id"], []).append(row["day"])
    condition = F.lit(False)
    for profile, own in days.items():
        condition = condition | (F.col("profile_id").eqNullSafe(F.lit(profile)) & F.col("day").isin(own))
    return condition


def _check_new_ids(stored: DataFrame, added: DataFrame) -> None:
    """Raise if a new turn has the id of another one; of the stored turns only the ids are read."""
    check_turn_ids(added)
    names = added.select("turn_id", *[F.col(c).alias(f"new_{c}") for c in SESSION_KEY])
    met = stored.select("turn_id", *SESSION_KEY).join(names, "turn_id")
    other = F.lit(False)
    for c in SESSION_KEY:
        other = other | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    if taken := met.where(other).limit(1).collect():
        raise ValueError(f"two turns have the id {taken[0]['turn_id']}; number them with assign_turn_ids")


def build_vectors(
    turns: DataFrame,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    text: str = "content",
) -> DataFrame:
    """turn_id, profile, time, role, the day where turns have it, and the quantised vector of the text."""
    kept = [*CARRIED, *[c for c in ("day",) if c in turns.columns]]
    source = turns.where(F.col(text).isNotNull()).select("turn_id", *kept, F.col(text).alias("content"))
    embedded = embed_texts(source, load_encoder, "content")
    return quantized(embedded).select("turn_id", *kept, "q8")
