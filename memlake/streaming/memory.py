"""Content scan, admission and audit on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from memlake.functions.guard import scan_issues
from memlake.operators.memory import GROUP, MEMORY_LIMIT, USER_LIMIT, admit_entries, event_fault, prepared_events, replay_event
from memlake.operators.provenance import audit_events, event_actions
from memlake.sources.tables import append_batch, read_log


def scanned(texts: DataFrame, text: str) -> DataFrame:
    """Works on batches and streams alike: no state."""
    return texts.withColumn("issues", scan_issues(F.col(text))).withColumn("is_safe", F.size("issues") == 0)


def stream_scan(texts: DataFrame, text: str, out_path: str, checkpoint: str) -> StreamingQuery:
    writer = scanned(texts, text).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_admit(
    candidates: DataFrame,
    out_path: str,
    checkpoint: str,
    memory_limit: int = MEMORY_LIMIT,
    user_limit: int = USER_LIMIT,
) -> StreamingQuery:
    """Judge arriving entries against the memories kept so far.

    A micro-batch is judged as a whole by the batch operator, so one busy memory
    does not end up in one task. The state is the log of accepted entries, at most
    one memory's capacity per memory. Entries that arrive late are judged on arrival.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = None
        if batch_id > 0:
            kept = read_log(spark, f"{out_path}/accepted").where(F.col("batch_id") < batch_id).select(*GROUP, "content")
        verdicts = admit_entries(batch, memory_limit, user_limit, kept)
        append_batch(verdicts, f"{out_path}/verdicts", batch_id)
        # Verdicts are written once and read back.
        written = spark.read.schema(verdicts.schema).parquet(f"{out_path}/verdicts/batch_id={batch_id}")
        append_batch(written.where(F.col("verdict") == "accepted"), f"{out_path}/accepted", batch_id)

    writer = candidates.writeStream.foreachBatch(judge)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MemoryReplay(StatefulProcessor):
    """One memory: its entries are the state, which its capacity bounds; each event gives a verdict."""

    STATE = "content string, event_id long, ts long, created_at long, source_session string, confidence string"

    def __init__(self, granularity: str) -> None:
        self.granularity = granularity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getListState("entries", self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id", "piece"], kind="stable")
        # Entries are (text, last change, first write); both are (event_id, ts, created_at, source_session, confidence).
        entries = [(text, (*own, *first), (*own, *first)) for text, *own_first in self.stored.get() for own, first in [(own_first[:2], own_first[2:])]]
        verdicts = []
        for event in events.itertuples(index=False):
            verdict = event.fault
            if not isinstance(verdict, str):
                place = (event.event_id, event.ts, event.ts, _text(event.source_session), _text(event.confidence))
                old, new = _text(event.old_text), _text(event.new_text)
                verdict, entries = replay_event(entries, event.op, old, new, place, event.capacity, self.granularity)
            verdicts.append(verdict)
        if entries:
            self.stored.put([(text, *changed[:2], *first[2:]) for text, changed, first in entries])
        else:
            self.stored.clear()
        yield events.assign(verdict=verdicts)[[field.split()[0] for field in REPLAYED.split(", ")]]

    def close(self) -> None:
        pass


REPLAYED = (
    "profile_id string, target string, event_id long, piece int, op string, ts long, old_text string, new_text string, "
    "source_session string, verdict string"
)
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _text(value: object) -> str | None:
    """Missing texts come as None or NaN."""
    return value if isinstance(value, str) else None


def replayed(events: DataFrame, memory_limit: int, user_limit: int, granularity: str) -> DataFrame:
    """Verdicts of a stream of events. What needs no other event is decided before the state is asked."""
    prepared = prepared_events(events, memory_limit, user_limit).drop("phase")
    too_long = (F.col("op") == "write") & (F.col("n_chars") > F.col("capacity"))
    judged = prepared.withColumn("fault", F.coalesce(event_fault(), F.when(too_long, "capacity")))
    return judged.groupBy(*GROUP).transformWithStateInPandas(MemoryReplay(granularity), REPLAYED, "append", "none")


def stream_replay(
    events: DataFrame,
    out_path: str,
    checkpoint: str,
    memory_limit: int = MEMORY_LIMIT,
    user_limit: int = USER_LIMIT,
    granularity: str = "substring",
) -> StreamingQuery:
    """Writes, updates and removals as they arrive; removals free room for later batches.

    Every memory is keyed state, so a batch costs what its events cost, however long the
    history is. Events of a batch are taken in order of (ts, event_id); late ones are judged on arrival. One memory's
    events of a batch are sorted by one task: the source's limits on a batch bound them. Verdicts go to ``verdicts`` below
    ``out_path``, whole events with them, so that ``stream_audit`` can log every accepted one.
    """
    if granularity not in ("substring", "entry"):
        raise ValueError(f"unknown granularity: {granularity}")
    spark = events.sparkSession
    before = spark.conf.get(STATE_STORE)
    # Keyed state of this kind needs that store; a query keeps the settings it started with.
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        writer = replayed(events, memory_limit, user_limit, granularity).writeStream.format("parquet").outputMode("append")
        started = writer.option("path", f"{out_path}/verdicts").option("checkpointLocation", checkpoint)
        return started.trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def current_memories(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The entries of all memories after the last finished batch, read from the state of ``stream_replay``; ``piece`` is their order."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entries")
    rows = state.option("flattenCollectionTypes", False).load()
    entry = F.posexplode("list_value").alias("piece", "entry")
    return rows.select("key.*", entry).select(*GROUP, "piece", "entry.*")


def stream_audit(spark: SparkSession, verdicts_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """One log row per accepted action, from the log of ``stream_admit`` (accepted) or ``stream_replay`` (verdicts):
    updates and removals too."""
    schema = spark.read.parquet(verdicts_path).schema
    verdicts = spark.readStream.schema(schema).parquet(verdicts_path)
    if "op" not in verdicts.columns:
        # Admitted entries are all writes.
        no_text = F.lit(None).cast("string")
        verdicts = verdicts.withColumns({"op": F.lit("write"), "old_text": no_text, "new_text": F.col("content")})
    log = audit_events(event_actions(verdicts))
    writer = log.writeStream.format("parquet").outputMode("append").option("path", out_path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
