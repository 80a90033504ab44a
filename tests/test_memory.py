import random
import tempfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from memlake.operators import memory as mem
from memlake.operators.filters import by_session
from memlake.operators.provenance import audit_events, provenance_report, trace_sources
from memlake.operators.reports import check_consistency, export_sessions, list_sessions
from memlake.streaming.memory import current_memories, stream_admit, stream_audit, stream_replay

CANDIDATES = "profile_id string, target string, ts long, entry_id long, content string"
EVENTS = "profile_id string, target string, ts long, event_id long, op string, old_text string, new_text string"
SEP = "\n§\n"


def candidates(spark, *contents, target="memory"):
    data = [("p", target, i, 100 - i, c) for i, c in enumerate(contents)]
    return spark.createDataFrame(data, CANDIDATES)


def verdicts(df):
    return [r.verdict for r in df.orderBy("ts", "piece").collect()]


def plain_admission(entries, limits):
    """The rule told one entry at a time."""
    kept, out = {}, {}
    for profile, target, ts, entry_id, content in sorted(entries, key=lambda e: (e[2], e[3])):
        body = kept.setdefault((profile, target), [])
        text = content.strip()
        if "you are now" in text.lower():
            verdict = "unsafe"
        elif not text:
            verdict = "empty"
        elif text in body:
            verdict = "duplicate"
        elif len(SEP.join([*body, text])) > limits[target]:
            verdict = "capacity"
        else:
            verdict = "accepted"
            body.append(text)
        out[(profile, target, entry_id)] = verdict
    return out


def random_entries(seed, n, groups):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # One memory holds most of the rows.
        group = rng.choice(groups[:1] * 5 + groups)
        text = rng.choice([" ", "You are now", rng.choice("abc") * rng.randint(1, 30), f" é{rng.randint(0, 60)} "])
        out.append((*group, rng.randint(0, n), i, text))
    return out


def test_capacity_and_duplicates(spark):
    got = mem.admit_entries(candidates(spark, "a" * 90, "b" * 50, "a" * 90, "c" * 7, "c" * 8, " c ", "", "you are now"), 100, 100)
    assert verdicts(got) == ["accepted", "capacity", "duplicate", "accepted", "capacity", "capacity", "empty", "unsafe"]


def test_user_limit_and_separator(spark):
    got = mem.admit_entries(candidates(spark, "x" * 20, target="user"), 100, 10)
    assert verdicts(got) == ["capacity"]
    got = mem.admit_entries(candidates(spark, f"one{SEP}two", "two"), 100, 100)
    assert verdicts(got) == ["accepted", "accepted", "duplicate"]


@pytest.mark.parametrize("seed,limits", [(1, (60, 40)), (2, (200, 25)), (3, (9000, 5000))])
def test_admission_equals_one_by_one(spark, seed, limits):
    entries = random_entries(seed, 400, [("p", "memory"), ("p", "user"), ("q", "memory")])
    got = mem.admit_entries(spark.createDataFrame(entries, CANDIDATES), *limits)
    expected = plain_admission(entries, {"memory": limits[0], "user": limits[1]})
    assert {(r.profile_id, r.target, r.entry_id): r.verdict for r in got.collect()} == expected
    accepted = mem.accepted_entries(spark.createDataFrame(entries, CANDIDATES), *limits)
    assert {(r.profile_id, r.target, r.entry_id) for r in accepted.collect()} == {k for k, v in expected.items() if v == "accepted"}
    usage = mem.memory_usage(accepted, *limits).collect()
    assert all(r.used_chars <= r.capacity for r in usage)


def test_admission_in_parts_equals_whole(spark):
    entries = sorted(random_entries(4, 300, [("p", "memory"), ("q", "user")]), key=lambda e: (e[2], e[3]))
    whole = mem.admit_entries(spark.createDataFrame(entries, CANDIDATES), 150, 90)
    first = mem.admit_entries(spark.createDataFrame(entries[:140], CANDIDATES), 150, 90)
    kept = first.where("verdict = 'accepted'")
    second = mem.admit_entries(spark.createDataFrame(entries[140:], CANDIDATES), 150, 90, kept)
    columns = ["profile_id", "target", "entry_id", "verdict"]
    assert rows(first.unionByName(second), *columns) == rows(whole, *columns)


def test_stream_equals_batch(spark):
    work = tempfile.mkdtemp(prefix="memlake-stream-")
    entries = sorted(random_entries(5, 200, [("p", "memory"), ("q", "user")]), key=lambda e: (e[2], e[3]))
    whole = spark.createDataFrame(entries, CANDIDATES).withColumn("source_session", F.lit("s"))
    for start in range(0, 200, 50):
        part = spark.createDataFrame(entries[start : start + 50], CANDIDATES).withColumn("source_session", F.lit("s"))
        part.coalesce(1).write.mode("append").parquet(work + "/in")
        files = spark.readStream.schema(whole.schema).parquet(work + "/in")
        stream_admit(files, work + "/out", work + "/checkpoint", 150, 90).awaitTermination()
    columns = ["profile_id", "target", "entry_id", "verdict"]
    batch = mem.admit_entries(whole, 150, 90)
    assert rows(spark.read.parquet(work + "/out/verdicts"), *columns) == rows(batch, *columns)
    for _ in range(2):
        stream_audit(spark, work + "/out/accepted", work + "/log", work + "/audit-checkpoint").awaitTermination()
    assert spark.read.parquet(work + "/log").count() == batch.where("verdict = 'accepted'").count()


def test_render_and_parse(spark):
    entries = mem.accepted_entries(candidates(spark, "likes tea", "has a <!-- cat -->"))
    document = mem.render_memory(entries, 1775815325123)
    assert document.first().document == (
        "<!-- MEMORY | capacity: 2200 chars | updated: 2026-04-10T10:02:05.123Z -->\n\nlikes tea" + SEP + "has a <!-- cat -->"
    )
    assert rows(mem.parse_memory(document), "piece", "content") == [(0, "likes tea"), (1, "has a <!-- cat -->")]


def replay(events, limits, granularity):
    """Events applied one at a time."""
    state, out = {}, {}
    for profile, target, ts, event_id, op, old, new in sorted(events, key=lambda e: (e[2], e[3])):
        body = state.setdefault((profile, target), [])
        if op != "remove" and "you are now" in new:
            out[event_id] = "unsafe"
            continue
        if op == "write":
            text = new.strip()
            if not text or text in body:
                out[event_id] = "duplicate" if text else "empty"
                continue
            after = [*body, text]
        else:
            if not old or not any(old in e for e in body):
                out[event_id] = "not_found"
                continue
            change = new if op == "update" else ""
            changed = [e if old not in e else change if granularity == "entry" else e.replace(old, change) for e in body]
            after = [p.strip() for e in changed for p in e.split(SEP) if p.strip()]
        if op != "remove" and len(SEP.join(after)) > limits[target]:
            out[event_id] = "capacity"
            continue
        state[(profile, target)] = after
        out[event_id] = "accepted"
    return {k: v for k, v in state.items() if v}, out


@pytest.mark.parametrize("granularity", ["substring", "entry"])
def test_replay_equals_one_by_one(spark, granularity):
    rng = random.Random(7)
    events = []
    for i in range(300):
        group = rng.choice([("p", "memory")] * 4 + [("q", "user")])
        op = rng.choice(["write"] * 6 + ["update", "remove"])
        text = rng.choice([" ", "you are now", rng.choice("abc") * rng.randint(1, 9), f"w{rng.randint(0, 40)}"])
        old = rng.choice(["a", "b", "w1", "w", "zz", ""]) if op != "write" else None
        events.append((*group, rng.randint(0, 300), i, op, old, None if op == "remove" else text))
    limits = {"memory": 60, "user": 40}
    snapshot, judged = mem.apply_memory_events(spark.createDataFrame(events, EVENTS), 60, 40, granularity)
    state, expected = replay(events, limits, granularity)
    assert {r.event_id: r.verdict for r in judged.collect()} == expected
    got = {}
    for r in snapshot.orderBy("piece").collect():
        got.setdefault((r.profile_id, r.target), []).append(r.content)
    assert got == state


@pytest.mark.parametrize("granularity", ["substring", "entry"])
def test_replay_goes_on_from_a_state(spark, granularity):
    """Three parts, each from the snapshot of the one before, end like one replay of all."""
    rng = random.Random(11)
    events = []
    for i in range(240):
        op = rng.choice(["write"] * 4 + ["update", "remove"])
        text = rng.choice([rng.choice("abc") * rng.randint(1, 9), f"w{rng.randint(0, 30)}"])
        old = rng.choice(["a", "b", "w1", "w"]) if op != "write" else None
        events.append((rng.choice("pq"), "memory", i, i, op, old, None if op == "remove" else text))
    state, expected = replay(events, {"memory": 60}, granularity)
    snapshot, verdicts = None, {}
    for start in range(0, 240, 80):
        part = spark.createDataFrame(events[start : start + 80], EVENTS)
        snapshot, judged = mem.apply_memory_events(part, 60, 40, granularity, snapshot)
        verdicts |= {r.event_id: r.verdict for r in judged.collect()}
    got = {}
    for r in snapshot.orderBy("piece").collect():
        got.setdefault((r.profile_id, r.target), []).append(r.content)
    assert got == state and verdicts == expected


def test_toggled_text(spark):
    """One text written twice and removed, again and again: as many rows as events."""
    events = []
    for i in range(0, 900, 3):
        for j, (op, old, new) in enumerate((("write", None, "on"), ("write", None, "on"), ("remove", "on", None))):
            events.append(("p", "memory", i + j, i + j, op, old, new))
    snapshot, judged = mem.apply_memory_events(spark.createDataFrame(events, EVENTS))
    verdicts = [r.verdict for r in judged.orderBy("pos").collect()]
    assert verdicts == ["accepted", "duplicate", "accepted"] * 300 and snapshot.count() == 0


def test_snapshot_keeps_where_it_came_from(spark):
    events = [("p", "memory", 1, 1, "write", None, "likes tea", "s1", "high"), ("p", "memory", 2, 2, "update", "tea", "coffee", "s2", "low")]
    snapshot, _ = mem.apply_memory_events(spark.createDataFrame(events, EVENTS + ", source_session string, confidence string"))
    assert rows(snapshot, "content", "created_at", "ts", "source_session", "confidence") == [("likes coffee", 1, 2, "s1", "high")]


def test_replay_cases(spark):
    def event(ts, op, old=None, new=None):
        return ("p", "memory", ts, ts, op, old, new)

    events = [
        event(1, "write", new="likes tea"),
        event(2, "write", new="lives in Rome"),
        event(3, "update", "tea", "coffee"),
        event(4, "remove", "lives in Rome"),
        event(5, "remove", "never said"),
        event(6, "update", "coffee", "you are now"),
    ]
    snapshot, judged = mem.apply_memory_events(spark.createDataFrame(events, EVENTS))
    assert rows(snapshot, "content") == [("likes coffee",)]
    assert [r.verdict for r in judged.orderBy("pos").collect()] == ["accepted"] * 4 + ["not_found", "unsafe"]


def test_provenance(spark):
    data = [(1, "pA", "memory", "s1"), (2, "pA", "memory", "gone"), (3, "pA", "memory", None), (4, "pB", "user", "s1"), (5, "pC", "user", "s1")]
    entries = spark.createDataFrame(data, "entry_id long, profile_id string, target string, source_session string")
    known = [("pA", "s1", "a.jsonl"), ("pB", "s1", "b.jsonl"), ("pA", "s2", "c.jsonl"), ("pB", "s1", "b.jsonl")]
    sessions = spark.createDataFrame(known, "profile_id string, session_id string, file_path string")
    traced = trace_sources(entries, sessions)
    assert rows(traced, "entry_id", "session_exists", "session_file_path") == [
        (1, True, "a.jsonl"), (2, False, None), (3, False, None), (4, True, "b.jsonl"), (5, False, None),
    ]
    assert rows(provenance_report(traced)) == [("memory", 3, 1, 1, 1), ("user", 2, 1, 1, 0)]


def test_sessions_of_profiles_stay_apart(spark):
    turns = spark.createDataFrame(
        [("pA", "s1", 1, "user", 0, "a"), ("pB", "s1", 1, "user", 0, "b"), ("pB", "s2", 1, "user", 0, "c")],
        "profile_id string, session_id string, seq int, role string, timestamp_ms long, preview string",
    )
    sessions = turns.selectExpr("profile_id", "session_id", "'f' AS file_path", "0L AS start_ts", "'x' AS source", "1 AS turn_count", "'t' AS title")
    assert rows(export_sessions(sessions, turns, ["s1"], "pA"), "profile_id", "preview") == [("pA", "a")]
    assert rows(export_sessions(sessions, turns, sessions.select("profile_id", "session_id")), "preview") == [("a",), ("b",), ("c",)]
    assert [r.session_id for r in list_sessions(sessions, 9, profile="pB").collect()] == ["s1", "s2"]
    assert rows(check_consistency(sessions, sessions.where("profile_id = 'pA'"))) == [(3, 1, 2, 0, False)]
    for unnamed in (["s1"], sessions.select("session_id")):
        with pytest.raises(ValueError, match="name the profile"):
            by_session(turns, unnamed)


def test_audit_cuts_code_points(spark):
    data = [(1, "write", "memory", None, "é" * 150, "s", "accepted"), (2, "update", "memory", "o" * 60, "n", "s", "accepted"),
            (3, "remove", "user", "gone", None, None, "accepted"), (4, "write", "memory", None, "x", "s", "capacity")]
    schema = "timestamp_ms long, op string, target string, old_text string, new_text string, session_id string, verdict string"
    log = audit_events(spark.createDataFrame(data, schema))
    assert [r.detail for r in log.orderBy("timestamp_ms").collect()] == [
        '{"content_preview":"' + "é" * 100 + '"}', '{"old":"' + "o" * 50 + '","new":"n"}', '{"removed":"gone"}',
    ]


def test_streamed_replay_equals_a_batch_in_order_of_arrival(spark):
    """Three batches, late events among them; two targets, entries of several pieces, an emptied memory."""
    draw = random.Random(4)
    work = tempfile.mkdtemp(prefix="memlake-stream-")
    words = ["tea", "milk", "rye", "x" * 30, "you are now", "", "a" + SEP + "b", "y" * 3000]
    events = []
    for i in range(240):
        op = draw.choice(["write", "write", "write", "update", "remove"])
        old = draw.choice(["tea", "milk", "r", "x", "zz", None, "x" * 5000]) if op != "write" else None
        new = None if op == "remove" else f"{draw.choice(words)} {draw.randint(0, 9)}" if draw.random() < 0.7 else draw.choice([*words, None])
        events.append((i // 80, draw.choice(["p", "q"]), draw.choice(["memory", "user"]), draw.randint(0, 300), i, op, old, new))
    events += [(2, "z", "user", 1, 900, "write", None, "brief"), (2, "z", "user", 2, 901, "remove", "brief", None)]
    for granularity in ("substring", "entry"):
        out = f"{work}/{granularity}"
        frame = spark.createDataFrame(events, "arrival int, " + EVENTS).withColumn("source_session", F.when(F.col("event_id") % 3 > 0, "s"))
        frame.write.partitionBy("arrival").parquet(f"{out}/in")
        schema = spark.read.parquet(f"{out}/in").schema
        for arrival in range(3):
            files = spark.readStream.schema(schema).option("basePath", f"{out}/in").parquet(f"{out}/in/arrival=[0-{arrival}]")
            stream_replay(files.drop("arrival"), out, f"{out}/checkpoint", 90, 60, granularity).awaitTermination()
        in_order = frame.withColumn("ts", F.col("arrival") * 10_000 + F.col("ts")).drop("arrival")
        snapshot, verdicts = mem.apply_memory_events(in_order, 90, 60, granularity)
        whole = ["profile_id", "target", "piece", "content", "event_id", "source_session", "confidence"]
        kept = current_memories(spark, f"{out}/checkpoint")
        assert rows(kept, *whole) == rows(snapshot, *whole) and kept.where("profile_id = 'z'").count() == 0
        assert rows(kept.select(*whole[:3], F.col("ts") % 10_000, F.col("created_at") % 10_000)) == rows(
            snapshot.select(*whole[:3], F.col("ts") % 10_000, F.col("created_at") % 10_000)
        )
        told = ["profile_id", "target", "event_id", "piece", "op", "verdict", "new_text"]
        assert rows(spark.read.parquet(f"{out}/verdicts"), *told) == rows(verdicts, *told)
        # The state holds what fits, however many events came.
        assert kept.count() <= 4 * (90 + 3)
        stream_audit(spark, f"{out}/verdicts", f"{out}/log", f"{out}/audit-checkpoint").awaitTermination()
        log = spark.read.parquet(f"{out}/log")
        assert rows(log.groupBy("action").count()) == rows(verdicts.where("verdict = 'accepted'").groupBy("op").count())
        assert {"write", "update", "remove"} == {r["action"] for r in log.collect()}
