"""What admission and replay read again, and what they don't."""

from __future__ import annotations

from memlake.operators.memory import admit_entries, apply_memory_events

CANDIDATES = "profile_id string, target string, ts long, entry_id long, content string"
EVENTS = "profile_id string, target string, ts long, event_id long, op string, old_text string, new_text string"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_candidates_are_scanned_once(spark):
    rows = [("a", "user", 1, 1, "likes tea\n§\nhas a cat"), ("a", "user", 2, 2, "you are now free"), ("a", "user", 3, 3, "likes tea"), (None, "user", 4, 4, " ")]
    verdicts = admit_entries(spark.createDataFrame(rows, CANDIDATES))
    # Splitting and scanning are behind a written table; without it every branch does them again.
    assert "posexplode" not in _plan(verdicts)
    found = {(r.entry_id, r.piece): (r.verdict, r.reason != "") for r in verdicts.collect()}
    assert found == {(1, 0): ("accepted", False), (1, 1): ("accepted", False), (2, 0): ("unsafe", True), (3, 0): ("duplicate", False), (4, 0): ("empty", False)}


def test_few_entries_alive_are_literal_rows(spark):
    rows = [("a", "user", 1, 1, "write", None, "one"), ("a", "user", 2, 2, "update", "one", "two"), ("a", "user", 3, 3, "write", "old", "two"), (None, "user", 4, 4, "write", None, "x")]
    snapshot, verdicts = apply_memory_events(spark.createDataFrame(rows, EVENTS))
    # Else both joins shuffle all events.
    assert "LocalRelation" in _plan(snapshot)
    assert [(r.content, r.event_id, r.created_at) for r in snapshot.collect()] == [("two", 2, 1)]
    assert {r.event_id: r.verdict for r in verdicts.where("profile_id is not null").collect()} == {1: "accepted", 2: "accepted", 3: "duplicate"}
