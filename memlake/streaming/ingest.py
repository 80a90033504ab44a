"""Archive files as a stream: each micro-batch is appended once, the newest version of a session wins on read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.operators.ingest import SESSION_KEY, build_sessions, build_turns, latest_version
from memlake.plans.rebuild import VERSION
from memlake.session import durable, settled, together
from memlake.sources.archive import ARCHIVE_FILES, WHOLE_FILE_BYTES, archive_of, parsed_lines, read_lines
from memlake.sources.tables import append_batch, drop_merged, due_merge, log_folder, log_folders, read_merged_log

# Up to this number of sessions of several versions is sent to the tasks; their rows need no shuffle then.
SENT_SESSIONS = 10_000
# Bytes of archive files from which one task builds the tables of a batch.
TASK_BYTES = 8 * 1024 * 1024


def stream_ingest(
    spark: SparkSession, archive_path: str, store_path: str, checkpoint: str, now_ms: int, files_per_batch: int = 1000, merge_every: int = 10
) -> StreamingQuery:
    """New archive files to append-only logs of turns, sessions and errors.

    A batch has its own folder, so a batch that runs twice writes the same folder again. Every ``merge_every``-th batch
    also merges the batches since the last merge, every ``merge_every``-th merge the merges before it, and
    so on: a row is written again once per level, and a reader opens less than ``merge_every`` folders of each
    level, however long the stream has run. What a merge replaced stays for one more round for its readers.
    """
    if merge_every < 2:
        raise ValueError("merge at least two batches")
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", ARCHIVE_FILES)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(archive_path)
        .select("path", "length")
    )

    def save(found: DataFrame, batch_id: int) -> None:
        # Names and sizes only, at most files_per_batch; the content is read by the tasks.
        files = found.collect()
        if not files:
            return
        small = all(file.length <= WHOLE_FILE_BYTES for file in files)
        lines = durable(parsed_lines(read_lines(spark, [file.path for file in files], all_small=small)), "stream-lines")
        # A batch of few bytes is one task's: it needs no shuffle, and leaves one file in each table.
        lines = lines.coalesce(1 + sum(file.length for file in files) // TASK_BYTES)
        archive = archive_of(lines, judged=small)
        # Of several versions in one batch the newest alone is stored.
        keep, _ = together(lambda: only_newest(archive.headers), lambda: append_batch(archive.errors, f"{store_path}/errors", batch_id))
        headers, turns = keep(archive.headers), keep(archive.turns)
        sessions = build_sessions(headers, turns, now_ms, carry=tuple(VERSION))
        sessions = sessions.select(*SESSION_KEY, *[c for c in sessions.columns if c not in SESSION_KEY])
        together(
            lambda: append_batch(sessions, f"{store_path}/sessions", batch_id),
            lambda: append_batch(build_turns(turns, carry=tuple(VERSION)), f"{store_path}/turns", batch_id),
        )
        if merged := due_merge(batch_id, merge_every):
            merge_batches(spark, store_path, batch_id + 1 - merged, batch_id, merge_every)

    writer = files.writeStream.foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def only_newest(versions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How to leave out the rows of versions that a newer one replaces, for tables that carry session and version.

    Few sessions have several versions: only these are looked up, and where there are none a table stays as it is.
    """
    version = F.struct(*VERSION)
    spans = versions.groupBy(*SESSION_KEY).agg(F.min(version).alias("_oldest"), F.max(version).alias("_newest"))
    several, rows = settled(spans.where("_oldest < _newest").select(*SESSION_KEY, "_newest"), SENT_SESSIONS, "several-versions")
    if rows == []:
        return lambda table: table

    def keep(table: DataFrame) -> DataFrame:
        joined = table.join(several if rows is None else F.broadcast(several), SESSION_KEY, "left")
        return joined.where(F.col("_newest").isNull() | (F.struct(*VERSION) == F.col("_newest"))).select(*table.columns)

    return keep


def merge_batches(spark: SparkSession, store_path: str, first: int, last: int, keep: int) -> None:
    """One folder for the batches from ``first`` to ``last``, with the newest version of each session among them. It takes
    their place once it is wholly written. Folders merged ``keep`` batches ago are deleted."""
    logs, done = {}, set()
    for table in ("sessions", "turns", "errors"):
        inside = [(a, b) for a, b in log_folders(spark, f"{store_path}/{table}") if first <= a and b <= last]
        if not inside:
            return
        if inside == [(first, last)]:
            done.add(table)
        logs[table] = spark.read.parquet(*[log_folder(f"{store_path}/{table}", a, b) for a, b in inside])
    current_rows = only_newest(logs["sessions"])
    merged = {"errors": logs["errors"], "turns": current_rows(logs["turns"]), "sessions": current_rows(logs["sessions"])}

    def put(table: str) -> None:
        # A merge that was cut short goes on with the tables it had not written.
        if table not in done:
            merged[table].write.mode("overwrite").parquet(log_folder(f"{store_path}/{table}", first, last))
        drop_merged(spark, f"{store_path}/{table}", last + 1 - keep)

    together(*[lambda table=table: put(table) for table in merged])


def current(spark: SparkSession, store_path: str, table: str) -> DataFrame:
    """The newest version of every session in a log.

    What is newest is read off the sessions: a version without turns replaces one with turns.
    """
    sessions = latest_version(read_merged_log(spark, f"{store_path}/sessions"), SESSION_KEY, VERSION)
    if table == "sessions":
        return sessions.drop(*VERSION)
    log = read_merged_log(spark, f"{store_path}/{table}")
    if not set(VERSION) <= set(log.columns):
        return log
    kept = sessions.select(*SESSION_KEY, *VERSION).distinct()
    return log.join(kept, [*SESSION_KEY, *VERSION], "left_semi").drop(*VERSION)


def compact(spark: SparkSession, store_path: str, new_path: str) -> None:
    """Write what is current to a new log of one batch, for a copy without history.

    Stop the stream, compact into a new folder, and go on there with the same checkpoint: its
    next batch number is larger than that of the compacted batch.
    """
    sessions = latest_version(read_merged_log(spark, f"{store_path}/sessions"), SESSION_KEY, VERSION)
    kept = durable(sessions.select(*SESSION_KEY, *VERSION).distinct(), "kept-versions")
    turns = read_merged_log(spark, f"{store_path}/turns").join(kept, [*SESSION_KEY, *VERSION], "left_semi")
    append_batch(turns, f"{new_path}/turns", -1)
    append_batch(sessions, f"{new_path}/sessions", -1)
    append_batch(read_merged_log(spark, f"{store_path}/errors"), f"{new_path}/errors", -1)
