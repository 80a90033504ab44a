"""Bounded memory: admission, replay of edits, rendering, usage.

A memory is one (profile_id, target). Whether an entry is admitted depends on all
entries admitted before it, yet no task sees a whole history:

* Room only shrinks while entries are added, so a later copy of a text can never
  be admitted, and among texts of one length those admitted are the first ones.
* A memory of capacity C has room for at most (C + 3) / (L + 3) texts of length L.

So the first copies are found by an aggregate, cut per length by that quota, and
only this short list (whose size depends on C alone) is folded in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.guard import is_unsafe, scan_issues
from memlake.functions.text import ENTRY_SEPARATOR, WHITE_SPACE, join_entries, split_entries, trim_text
from memlake.functions.times import to_iso
from memlake.operators.ranking import running_counts, skewed_join, top_by_quota
from memlake.session import durable, settled

# The targets, their capacities in code points and header labels.
USER_TARGET = "user"
MEMORY_LIMIT = 2200
USER_LIMIT = 1375
LABELS = {"user": "USER PROFILE", "memory": "MEMORY"}
DEFAULT_CONFIDENCE = "medium"

GROUP = ["profile_id", "target"]
SEPARATOR_CHARS = len(ENTRY_SEPARATOR)
ORDER = ["ts", "entry_id", "piece"]


def capacity_of(target: Column, memory_limit: int = MEMORY_LIMIT, user_limit: int = USER_LIMIT) -> Column:
    return F.when(target == USER_TARGET, user_limit).otherwise(memory_limit)


def _pieces(candidates: DataFrame, memory_limit: int, user_limit: int) -> DataFrame:
    """Scan the whole text, then split it on the entry separator and trim.

    ``fault`` is the verdict that needs no other entry; NULL where the history decides.
    """
    scanned = candidates.withColumn("unsafe", is_unsafe(F.col("content")))
    parts = F.posexplode_outer(F.split("content", ENTRY_SEPARATOR)).alias("piece", "part")
    split = scanned.select(*[c for c in scanned.columns if c != "content"], F.col("content").alias("whole"), parts)
    trimmed = split.where(F.col("part").isNotNull()).withColumn("content", trim_text(F.col("part"))).drop("part")
    sized = trimmed.select(
        "*",
        F.char_length("content").cast("long").alias("n_chars"),
        capacity_of(F.col("target"), memory_limit, user_limit).cast("long").alias("capacity"),
    )
    fault = (
        F.when(F.col("unsafe"), "unsafe")
        .when(F.col("content") == "", "empty")
        .when(F.col("n_chars") > F.col("capacity"), "capacity")
    )
    return sized.withColumn("fault", fault).drop("unsafe")


def _quota() -> Column:
    return F.floor((F.col("capacity") + SEPARATOR_CHARS) / (F.col("n_chars") + SEPARATOR_CHARS))


def _largest_quota(*limits: int) -> int:
    """The quota of texts of one character."""
    return (max(limits) + SEPARATOR_CHARS) // (1 + SEPARATOR_CHARS)


def _admitted(viable: DataFrame, kept: DataFrame | None, most: int) -> DataFrame:
    """The entries that get in: GROUP, content, first (the order of its first copy).
    ``most`` is the largest quota of any length."""
    firsts = viable.groupBy(*GROUP, "content").agg(
        F.min(F.struct(*ORDER)).alias("first"), F.first("n_chars").alias("n_chars"), F.first("capacity").alias("capacity")
    )
    if kept is None:
        firsts = firsts.withColumn("used", F.lit(0).cast("long"))
    else:
        firsts = firsts.join(kept.select(*GROUP, "content"), [*GROUP, "content"], "left_anti")
        used = kept.groupBy(*GROUP).agg(F.sum(F.char_length("content") + SEPARATOR_CHARS).alias("used"))
        firsts = firsts.join(used, GROUP, "left").fillna(0, ["used"])
    short = top_by_quota(firsts, [*GROUP, "n_chars"], [F.col("first").asc()], _quota(), most)

    entry = F.struct("first", "n_chars", "content")
    groups = short.groupBy(*GROUP, "capacity", "used").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    empty = F.filter("entries", lambda _: F.lit(False))
    start = F.struct(F.col("used").alias("used"), empty.alias("taken"))

    def step(state: Column, item: Column) -> Column:
        fits = state["used"] + item["n_chars"] <= F.col("capacity")
        return F.struct(
            F.when(fits, state["used"] + item["n_chars"] + SEPARATOR_CHARS).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["taken"], F.array(item))).otherwise(state["taken"]).alias("taken"),
        )

    folded = groups.select(*GROUP, F.explode(F.aggregate("entries", start, step)["taken"]).alias("entry"))
    return folded.select(*GROUP, F.col("entry.content").alias("content"), F.col("entry.first").alias("first"))


def admit_entries(
    candidates: DataFrame,
    memory_limit: int = MEMORY_LIMIT,
    user_limit: int = USER_LIMIT,
    kept: DataFrame | None = None,
) -> DataFrame:
    """A verdict for every candidate entry, judged in order of (ts, entry_id).

    candidates: profile_id, target, ts, entry_id, content and any further columns.
    ``kept`` holds entries already in the memories (profile_id, target, content).
    Verdicts: accepted, duplicate, capacity, unsafe, empty. Content that holds the
    separator counts as several entries, told apart by ``piece``.
    """
    pieces = _pieces(candidates, memory_limit, user_limit)
    columns = [c for c in pieces.columns if c not in ("fault", "whole")]
    issues = F.array_join(scan_issues(F.col("whole")), "; ")
    # Texts are scanned once; what is judged is read several times.
    pieces = durable(pieces.select(*columns, "fault", F.when(F.col("fault").isNotNull(), issues).alias("reason")), "pieces")
    viable = pieces.where(F.col("fault").isNull())
    admitted = _admitted(viable, kept, _largest_quota(memory_limit, user_limit))
    if kept is not None:
        before = kept.select(*GROUP, "content").withColumn("first", F.lit(None).cast(admitted.schema["first"].dataType))
        admitted = admitted.unionByName(before)
    known = admitted.withColumn("known", F.lit(True))

    judged = skewed_join(viable.select(*columns), known, [*GROUP, "content"], "left")
    verdict = (
        F.when(F.col("known").isNull(), "capacity")
        .when(F.col("first") == F.struct(*ORDER), "accepted")
        .otherwise("duplicate")
    )
    judged = judged.select(*columns, verdict.alias("verdict"), F.lit("").alias("reason"))
    faulty = pieces.where(F.col("fault").isNotNull())
    return judged.unionByName(faulty.select(*columns, F.col("fault").alias("verdict"), "reason"))


def accepted_entries(
    candidates: DataFrame, memory_limit: int = MEMORY_LIMIT, user_limit: int = USER_LIMIT, kept: DataFrame | None = None
) -> DataFrame:
    """Only the entries that get in; the rejected ones need not be judged one by one."""
    viable = _pieces(candidates, memory_limit, user_limit).where(F.col("fault").isNull())
    return _admitted(viable, kept, _largest_quota(memory_limit, user_limit)).select(*GROUP, "content", "first.*")


def rejected_entries(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict") != "accepted")


def render_memory(
    entries: DataFrame,
    updated_ms: int,
    memory_limit: int = MEMORY_LIMIT,
    user_limit: int = USER_LIMIT,
) -> DataFrame:
    """One document per memory: a capacity header and the entries in order.

    entries: GROUP, content, ts, entry_id, piece. They fit the capacity, so a group is small.
    """
    row = F.struct(*ORDER, "content")
    body = entries.groupBy(*GROUP).agg(join_entries(F.array_sort(F.collect_list(row))["content"]).alias("body"))
    label = F.when(F.col("target") == USER_TARGET, LABELS["user"]).otherwise(LABELS["memory"])
    limit = capacity_of(F.col("target"), memory_limit, user_limit).cast("string")
    header = F.concat(
        F.lit("<!-- "), label, F.lit(" | capacity: "), limit, F.lit(" chars | updated: "), to_iso(F.lit(updated_ms)), F.lit(" -->")
    )
    return body.select(*GROUP, "body", F.concat(header, F.lit("\n\n"), F.col("body")).alias("document"))


def parse_memory(documents: DataFrame, column: str = "document") -> DataFrame:
    """The entries of rendered documents, numbered from 0."""
    body = F.regexp_replace(F.col(column), r"^<!-- [^\n]* -->\n\n?", "")
    return documents.select(*GROUP, F.posexplode(split_entries(body)).alias("piece", "content"))


def memory_usage(
    entries: DataFrame, memory_limit: int = MEMORY_LIMIT, user_limit: int = USER_LIMIT, near_full: float = 0.8
) -> DataFrame:
    """Characters used per memory (separators included), percent, and a near-full flag."""
    sums = entries.groupBy(*GROUP).agg(
        F.count("*").alias("n_entries"),
        (F.sum(F.char_length("content") + SEPARATOR_CHARS) - SEPARATOR_CHARS).alias("used_chars"),
    )
    limit = capacity_of(F.col("target"), memory_limit, user_limit).cast("long")
    share = F.col("used_chars") / F.col("capacity")
    return sums.withColumn("capacity", limit).select(
        "*", F.round(100 * share, 2).alias("used_percent"), (share > near_full).alias("near_full")
    )


def list_entries(entries: DataFrame, target: str | None = None, profile: str | None = None) -> DataFrame:
    """Newest first; of one profile or target, or of all."""
    for column, value in (("target", target), ("profile_id", profile)):
        if value is not None:
            entries = entries.where(F.col(column) == value)
    return entries.orderBy(F.col("created_at").desc(), F.col("entry_id").asc(), F.col("piece").asc())


# --- replay of write, update and remove events --------------------------------

ATTRIBUTES = ["created_at", "source_session", "confidence"]
# What a replayed event is known by, and what is kept of it for logs.
_EVENT = [*GROUP, "event_id", "piece", "pos"]
_LOGGED = ["op", "ts", "old_text", "new_text", "source_session"]
# Entries of a state, put before all events.
KEEP = "keep"

# Entries of all memories that are joined as literal rows.
FEW_ALIVE = 1_000

_OUTCOME = (
    "kind string, profile_id string, target string, event_id long, piece int, pos long, verdict string, "
    "content string, born long, died long, origin long"
)
_REPLAYED = [*_EVENT, "op", "old_text", "new_text", "unsafe", "capacity"]


def apply_memory_events(
    events: DataFrame,
    memory_limit: int = MEMORY_LIMIT,
    user_limit: int = USER_LIMIT,
    granularity: str = "substring",
    state: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replay events in order of (ts, event_id); returns (snapshot, verdicts).

    events: profile_id, target, ts, event_id, op (write, update, remove),
    old_text, new_text, and optionally source_session and confidence. A write takes
    ``new_text``. ``granularity`` tells whether update and remove change the matching
    substring or the whole matching entry. ``state`` is an earlier snapshot to go on from.

    The snapshot has the entries with ``ts`` and ``event_id`` of their last change, and ``created_at``,
    ``source_session`` and ``confidence`` of the write they came from. Verdicts carry the event.

    Between two edits only writes happen, so the short-list argument above holds
    for them and the other writes skip the replay; so do edits that can match nothing. The
    edits of one memory depend on each other: what is left of a memory is replayed in order by one
    task, which holds no more than the memory itself (bounded by its capacity) and one batch of events.
    """
    if granularity not in ("substring", "entry"):
        raise ValueError(f"unknown granularity: {granularity}")
    prepared = prepared_events(events, memory_limit, user_limit, state)
    is_edit, is_write = F.col("op") != "write", F.col("op") == "write"
    counts = {"pos": F.lit(1), "segment": is_edit}
    placed = durable(running_counts(prepared, GROUP, ["phase", "ts", "event_id", "piece"], counts), "replay-events")

    most = _largest_quota(memory_limit, user_limit)
    writes = placed.where(is_write & event_fault().isNull() & (F.col("n_chars") <= F.col("capacity")))
    # A place is an event's own: what the replay needs of the first write is gathered with it.
    own = [F.min_by(name, "pos").alias(name) for name in ("event_id", "piece")]
    firsts = writes.dropna(subset=GROUP).groupBy(*GROUP, "segment", "new_text", "n_chars", "capacity").agg(F.min("pos").alias("pos"), *own)
    short = top_by_quota(firsts, [*GROUP, "segment", "n_chars"], [F.col("pos").asc()], _quota(), most)
    constant = {"op": F.lit("write"), "old_text": F.lit(None).cast("string"), "unsafe": F.lit(False)}
    edits = placed.where(is_edit & event_fault().isNull()).select(*_REPLAYED)
    replayed = edits.unionByName(short.withColumns(constant).select(*_REPLAYED))
    ordered = replayed.repartition(*GROUP).sortWithinPartitions(*GROUP, "pos")
    outcomes = durable(ordered.mapInArrow(_replay(granularity), _OUTCOME), "replay-outcome")

    alive = outcomes.where(F.col("kind") == "alive").select(*GROUP, "piece", "content", "born", "origin")
    # Few rows where memories are few: then the events stay where they are.
    alive, _ = settled(alive, FEW_ALIVE, "alive")
    changed = placed.select(*GROUP, F.col("pos").alias("born"), "event_id", "ts")
    written = placed.select(*GROUP, F.col("pos").alias("origin"), *ATTRIBUTES)
    snapshot = alive.join(changed, [*GROUP, "born"]).join(written, [*GROUP, "origin"])
    snapshot = snapshot.select(*GROUP, "piece", "content", "event_id", "ts", *ATTRIBUTES)
    return snapshot, _event_verdicts(placed.where(F.col("op") != KEEP), outcomes)


def prepared_events(events: DataFrame, memory_limit: int, user_limit: int, state: DataFrame | None = None) -> DataFrame:
    """Scanned events; a write that holds the separator becomes several. Entries of a state come first."""
    new_text = F.coalesce("new_text", F.lit(""))
    parts = F.when(F.col("op") == "write", F.transform(F.split(new_text, ENTRY_SEPARATOR), trim_text))
    optional = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("source_session", "confidence")]
    split = events.select(
        *GROUP,
        F.lit(1).alias("phase"),
        "ts",
        "event_id",
        "op",
        "old_text",
        (is_unsafe(new_text) & (F.col("op") != "remove")).alias("unsafe"),
        F.col("ts").alias("created_at"),
        *optional,
        F.posexplode_outer(F.coalesce(parts, F.array(new_text))).alias("piece", "new_text"),
    )
    if state is not None:
        split = split.unionByName(
            state.select(
                *GROUP,
                F.lit(0).alias("phase"),
                # The order within a memory is that of the pieces.
                F.col("ts"),
                "event_id",
                F.lit(KEEP).alias("op"),
                F.lit(None).cast("string").alias("old_text"),
                F.lit(False).alias("unsafe"),
                *ATTRIBUTES,
                "piece",
                F.col("content").alias("new_text"),
            )
        )
        # Kept entries are ordered by their place, events by time.
        split = split.withColumn("phase", F.when(F.col("phase") == 0, F.col("piece") - 2_000_000_000).otherwise(F.lit(1)))
    capacity = capacity_of(F.col("target"), memory_limit, user_limit).cast("long")
    return split.select("*", capacity.alias("capacity"), F.char_length("new_text").cast("long").alias("n_chars"))


def event_fault() -> Column:
    """Verdicts that need no other event. A text longer than the memory is in none of its entries."""
    old = F.coalesce("old_text", F.lit(""))
    nowhere = F.col("op").isin("update", "remove") & ((old == "") | (F.char_length(old) > F.col("capacity")))
    return (
        F.when(F.col("unsafe"), "unsafe")
        .when((F.col("op") == "write") & (F.col("new_text") == ""), "empty")
        .when(nowhere, "not_found")
    )


def _replay(granularity: str):
    """Events sorted by memory and place to their outcomes, one memory after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in _OUTCOME.split(", ")]
        types = [pa.string()] * 3 + [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        key, entries = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def alive() -> list[tuple]:
            return [("alive", *key, None, i, None, None, text, born, None, origin) for i, (text, born, origin) in enumerate(entries)]

        for batch in batches:
            out = []
            for event in zip(*(batch.column(c).to_pylist() for c in _REPLAYED)):
                profile, target, event_id, piece, pos, op, old, new, _, capacity = event
                if key != (profile, target):
                    out += alive() if key else []
                    key, entries = (profile, target), []
                verdict, after = replay_event(entries, op, old, new, pos, capacity, granularity)
                out.append(("event", *key, event_id, piece, pos, verdict, None, None, None, None))
                if op in ("update", "remove") and verdict == "accepted":
                    left = {(text, born) for text, born, _ in after}
                    gone = [e for e in entries if e[:2] not in left]
                    out += [("life", *key, None, None, None, None, text, born, pos, origin) for text, born, origin in gone]
                entries = after
            yield batch_of(out)
        if key:
            yield batch_of(alive())

    return run


def replay_event(entries: list, op: str, old: str, new: str, pos: object, capacity: int, granularity: str) -> tuple[str, list]:
    """Entries are (text, place of the last change, place of the first write)."""
    if op == KEEP:
        return "accepted", [*entries, (new, pos, pos)]
    if op == "write":
        if any(text == new for text, *_ in entries):
            return "duplicate", entries
        after = [*entries, (new, pos, pos)]
    else:
        new = new if op == "update" else ""
        if not any(old in text for text, *_ in entries):
            return "not_found", entries
        after = []
        for text, born, origin in entries:
            if old not in text:
                after.append((text, born, origin))
            else:
                changed = new if granularity == "entry" else text.replace(old, new)
                after += [(part, pos, origin) for part in _entry_texts(changed)]
    if op != "remove" and len(ENTRY_SEPARATOR.join(text for text, *_ in after)) > capacity:
        return "capacity", entries
    return "accepted", after


def _entry_texts(body: str) -> list[str]:
    parts = [part.strip(WHITE_SPACE) for part in body.split(ENTRY_SEPARATOR)]
    return [part for part in parts if part]


def _event_verdicts(placed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Verdicts of all events. A write that skipped the replay is a duplicate if an
    entry with its text was alive at its place, else there was no room for it.

    Whether one was alive is counted: births less ends of that text in the memory before the
    write, over slices of the sorted rows, so that no text's history meets in one task.
    """
    columns = [*_EVENT, *_LOGGED, "verdict"]
    played = outcomes.where(F.col("kind") == "event").select(*_EVENT, "verdict")
    judged = placed.select(*_EVENT, *_LOGGED).join(played, _EVENT).select(*columns)

    skipped = placed.join(played, _EVENT, "left_anti")
    own_fault = skipped.where(event_fault().isNotNull()).withColumn("verdict", event_fault()).select(*columns)
    undecided = skipped.where(event_fault().isNull())

    fits = undecided.where(F.col("n_chars") <= F.col("capacity"))
    too_long = undecided.where(F.col("n_chars") > F.col("capacity")).withColumn("verdict", F.lit("capacity")).select(*columns)
    lives = outcomes.where(F.col("kind").isin("life", "alive")).withColumnRenamed("content", "new_text")
    # At one place a write is before what its event ends, and that before what it makes.
    rows = (
        fits.select(*GROUP, "new_text", "pos", F.lit(0).alias("step"), "event_id", "piece", *[c for c in _LOGGED if c != "new_text"])
        .unionByName(lives.where("died IS NOT NULL").select(*GROUP, "new_text", F.col("died").alias("pos"), F.lit(1).alias("step")), True)
        .unionByName(lives.select(*GROUP, "new_text", F.col("born").alias("pos"), F.lit(2).alias("step")), True)
    )
    flags = {"births": F.col("step") == 2, "ends": F.col("step") == 1}
    counted = running_counts(rows, [*GROUP, "new_text"], ["pos", "step"], flags).where("step = 0")
    copy = F.when(F.col("births") > F.col("ends"), "duplicate").otherwise("capacity")
    rest = counted.withColumn("verdict", copy).select(*columns)
    return judged.unionByName(own_fault).unionByName(too_long).unionByName(rest)
