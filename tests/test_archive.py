import json
import os
import tempfile

import pytest
from conftest import rows

from memlake.operators.ingest import build_sessions, build_turns, latest_version, upsert_sessions
from memlake.operators.keyword import keyword_search
from memlake.operators.reports import check_consistency
from memlake.plans.rebuild import Store, newest, rebuild_index
from memlake.sources import archive as ar
from memlake.sources.archive import list_archive, read_archive, write_archive
from memlake.sources.tables import append_batch, due_merge, log_folders
from memlake.streaming import ingest as streamed
from memlake.streaming.ingest import current, merge_batches, stream_ingest

NOW = 1_800_000_000_000


def header(session, start="2026-04-10T10:02:00.000+08:00", **more):
    return {"v": 1, "type": "session_header", "session_id": session, "start_time": start, "profile_id": "default", "tags": [], **more}


def turn(seq, content, role="user", ts="2026-04-10T10:02:05.123+08:00", **more):
    return {"ts": ts, "seq": seq, "role": role, "content": content, **more}


def put(folder, name, *lines):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(line if isinstance(line, str) else json.dumps(line, ensure_ascii=False) for line in lines) + "\n")
    return path


def sample():
    folder = tempfile.mkdtemp(prefix="memlake-archive-")
    usage = {"model": "m", "usage": {"input_tokens": 10, "output_tokens": 20}}
    put(folder, "2026/04/10/a.jsonl", header("aaaaaaaa-1"), turn(1, "你好"), "", turn(2, "hello there", "assistant", **usage))
    put(folder, "2026/04/10/b.jsonl", header("aaaaaaaa-2", tags=["x"], title="T"), turn(1, "alone", ts="bad"))
    put(folder, "2026/04/11/bad.jsonl", header("cccc"), turn(1, "fine"), "{broken")
    put(folder, "2026/04/11/nostart.jsonl", header("dddd", start="soon"), turn(1, "x"))
    return folder


def test_read(spark):
    archive = read_archive(spark, sample())
    assert rows(archive.turns, "session_id", "pos", "seq", "role", "content") == [
        ("aaaaaaaa-1", 1, 1, "user", "你好"),
        ("aaaaaaaa-1", 2, 2, "assistant", "hello there"),
        ("aaaaaaaa-2", 1, 1, "user", "alone"),
    ]
    metadata = [json.loads(r.metadata) for r in archive.turns.where("metadata IS NOT NULL").collect()]
    assert metadata == [{"model": "m", "usage": {"input_tokens": 10, "output_tokens": 20}}]
    assert rows(archive.errors, "pos", "reason") == [(0, "bad start time"), (2, "bad turn")]


def test_large_files_are_read_like_small_ones(spark):
    folder = sample()
    # Several blocks in one file, read in many splits.
    lines = []
    for s in range(30):
        lines += [header(f"big-{s}"), *[turn(i, f"line {i} " + "x" * 200) for i in range(1, 20)]]
    put(folder, "big.jsonl", *lines)
    whole = read_archive(spark, folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = read_archive(spark, folder, whole_file_bytes=0)
        assert split.turns.rdd.getNumPartitions() > 0
        for table in ("headers", "turns", "errors"):
            assert rows(getattr(split, table)) == rows(getattr(whole, table))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole.turns.where("session_id LIKE 'big-%'").count() == 30 * 19


def test_tables(spark):
    archive = read_archive(spark, sample())
    sessions = build_sessions(archive.headers, archive.turns, NOW)
    assert rows(sessions, "session_id", "turn_count", "total_tokens", "tags", "end_ts") == [
        ("aaaaaaaa-1", 2, 30, None, 1775786525123),
        ("aaaaaaaa-2", 1, 0, '["x"]', None),
    ]
    turns = build_turns(archive.turns)
    assert rows(turns, "session_id", "char_count", "n_chars", "timestamp_ms") == [
        ("aaaaaaaa-1", 11, 11, 1775786525123),
        ("aaaaaaaa-1", 6, 2, 1775786525123),
        ("aaaaaaaa-2", 5, 5, 1775786520000),
    ]


def test_token_modes(spark):
    folder = tempfile.mkdtemp(prefix="memlake-archive-")
    half = {"usage": {"input_tokens": 7}}
    text = {"usage": {"input_tokens": "7", "output_tokens": 2}}
    put(folder, "a.jsonl", header("s"), turn(1, "a", **half), turn(2, "b", **text), turn(3, "c"))
    archive = read_archive(spark, folder)
    for mode, total in (("lenient", 9), ("strict", 0)):
        assert rows(build_sessions(archive.headers, archive.turns, NOW, mode), "total_tokens") == [(total,)]


def test_round_trip_with_long_sessions(spark, monkeypatch):
    monkeypatch.setattr(ar, "BLOCK_TURNS", 4)
    folder = tempfile.mkdtemp(prefix="memlake-archive-")
    put(folder, "a.jsonl", header("long"), *[turn(i, f'text "{i}"\n€', model="m" if i % 2 else None) for i in range(1, 12)])
    put(folder, "b.jsonl", header("empty"))
    first = read_archive(spark, folder)
    out = tempfile.mkdtemp(prefix="memlake-archive-") + "/out"
    write_archive(first.headers, first.turns, out, version=5)
    again = read_archive(spark, out)
    columns = ["session_id", "pos", "ts", "seq", "role", "content", "metadata"]
    assert rows(again.turns, *columns) == rows(first.turns, *columns)
    assert rows(again.headers, "session_id", "part") == [("empty", 0), ("long", 0), ("long", 4), ("long", 8)]
    assert rows(build_sessions(again.headers, again.turns, NOW), "session_id", "turn_count") == [("empty", 0), ("long", 11)]
    assert "year=2026/month=04/day=10" in list_archive(spark, out).where("file_size > 0").first().file_path


def test_rewriting_what_was_read(spark):
    """Headers of many blocks are written once; blocks end at their bytes, too."""
    folder = tempfile.mkdtemp(prefix="memlake-archive-")
    put(folder, "a.jsonl", header("s", title="T"), *[turn(i, "x" * 50) for i in range(1, 8)])
    put(folder, "b.jsonl", header("s", profile_id="other"), turn(1, "only"))
    archive = read_archive(spark, folder)
    columns = ["profile_id", "session_id", "pos", "content"]
    want = rows(archive.turns, *columns)
    for block_bytes in (300, 10**9, 1):
        out = tempfile.mkdtemp(prefix="memlake-archive-") + "/out"
        ar.BLOCK_BYTES, kept = block_bytes, ar.BLOCK_BYTES
        try:
            write_archive(archive.headers, archive.turns, out, version=1)
        finally:
            ar.BLOCK_BYTES = kept
        archive = read_archive(spark, out)
        assert rows(archive.turns, *columns) == want
    assert archive.headers.count() == 8


EDGES = [
    "\r\n \t\r\n{head}\r\n\t\r\n{one}\r\n{two}",
    "{head}\n{one}\r\n\x0b\n\u3000\n{two}\r",
    "{head}\n{cr}\n{two}\n",
    "\n\n{head}",
    "{head}\n{one}\n{broken}\n",
    " \n",
    "",
]


def test_edge_files_read_alike(spark):
    """Whatever its size, a file gives the same rows."""
    folder = tempfile.mkdtemp(prefix="memlake-archive-")
    for i, edge in enumerate(EDGES):
        one, two = (json.dumps(turn(n, f"text {n}")) for n in (1, 2))
        # A lone carriage return between two parts of a line is white space of JSON.
        line = edge.format(head=json.dumps(header(f"s{i}")), one=one, two=two, cr=one.replace(", ", ",\r"), broken="{")
        with open(f"{folder}/{i}.jsonl", "w", encoding="utf-8", newline="") as out:
            out.write(line)
    whole = read_archive(spark, folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        split = read_archive(spark, folder, whole_file_bytes=0)
        for table in ("headers", "turns", "errors"):
            assert rows(getattr(split, table)) == rows(getattr(whole, table))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    counts = {r["session_id"]: r["count"] for r in whole.turns.groupBy("session_id").count().collect()}
    assert counts == {"s0": 2, "s1": 2, "s2": 2} and whole.headers.count() == 4 and whole.errors.count() == 1


def test_two_writes_of_one_version(spark):
    """One of them wins as a whole."""
    folder, out = tempfile.mkdtemp(prefix="memlake-archive-"), tempfile.mkdtemp(prefix="memlake-archive-") + "/out"
    for name in ("a", "b"):
        put(f"{folder}/{name}", "x.jsonl", header("s"), turn(1, f"{name} 1"), turn(2, f"{name} 2"))
        archive = read_archive(spark, f"{folder}/{name}")
        write_archive(archive.headers, archive.turns, out, version=1)
    kept = [t for (t,) in rows(newest(read_archive(spark, out)).turns, "content")]
    assert kept in (["a 1", "a 2"], ["b 1", "b 2"])


def test_profiles_and_repeated_numbers(spark):
    """Two profiles share a session id and a number repeats: every turn has its own id."""
    folder, store = tempfile.mkdtemp(prefix="memlake-archive-"), tempfile.mkdtemp(prefix="memlake-store-") + "/s"
    put(folder, "a.jsonl", header("s", profile_id="1"), turn(1, "red"), turn(1, "green"))
    put(folder, "b.jsonl", header("s", profile_id="01"), turn(1, "blue"), turn(1, "blue"))
    rebuild_index(spark, folder, store, NOW, buckets=3)
    found = Store(store)
    assert rows(found.turns(spark), "profile_id", "content") == [("01", "blue"), ("01", "blue"), ("1", "green"), ("1", "red")]
    assert found.turns(spark).select("turn_id").distinct().count() == 4
    assert rows(found.sessions(spark), "profile_id", "turn_count") == [("01", 2), ("1", 2)]
    queries = spark.createDataFrame([(1, "blue")], "query_id long, text string")
    assert keyword_search(found.index(spark), queries, 9).count() == 2
    assert keyword_search(found.index(spark, "1"), queries, 9).count() == 0
    assert found.index(spark).buckets == 3 and rows(found.index(spark, "01").corpus) == [(2, 1.0)]


def test_overwritten_session(spark):
    """The later version has fewer turns; old words are found no more."""
    folder = tempfile.mkdtemp(prefix="memlake-archive-") + "/a"
    for version, texts in ((1, ["ancient words", "more words"]), (2, ["modern"])):
        source = tempfile.mkdtemp(prefix="memlake-archive-")
        start = f"2026-04-1{version}T00:00:00Z"
        put(source, "s.jsonl", header("same", start), *[turn(i, t) for i, t in enumerate(texts, 1)])
        one = read_archive(spark, source)
        write_archive(one.headers, one.turns, folder, version=version)
    store = tempfile.mkdtemp(prefix="memlake-store-") + "/s"
    stats = rebuild_index(spark, folder, store, NOW)
    assert rows(stats) == [(1, 1, 1, 0)]
    index = Store(store).index(spark)
    queries = spark.createDataFrame([(1, "ancient"), (2, "modern")], "query_id long, text string")
    assert rows(keyword_search(index, queries, 5), "query_id") == [(2,)]


def test_rebuild_counts_and_sync(spark):
    folder, store = sample(), tempfile.mkdtemp(prefix="memlake-store-") + "/s"
    assert rows(rebuild_index(spark, folder, store, NOW, with_vectors=False)) == [(2, 3, 0, 2)]
    archive = newest(read_archive(spark, folder))
    sync = check_consistency(archive.headers, Store(store).sessions(spark))
    assert rows(sync) == [(2, 2, 0, 0, True)]


def test_upsert_and_latest(spark):
    schema = "profile_id string, session_id string, seq int"
    stored = spark.createDataFrame([("p", "a", 1), ("p", "a", 2), ("p", "b", 1), ("q", "a", 5)], schema)
    incoming = spark.createDataFrame([("p", "a", 9), ("p", "c", 1)], schema)
    assert rows(upsert_sessions(stored, incoming)) == [("p", "a", 9), ("p", "b", 1), ("p", "c", 1), ("q", "a", 5)]
    emptied = spark.createDataFrame([("p", "b")], "profile_id string, session_id string")
    assert rows(upsert_sessions(stored, incoming.limit(0), emptied)) == [("p", "a", 1), ("p", "a", 2), ("q", "a", 5)]
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, version int, v string")
    assert rows(latest_version(versions, ["k"], ["version"]), "v") == [("w",), ("y",), ("z",)]


def test_stream_equals_batch(spark):
    folder = sample()
    work = tempfile.mkdtemp(prefix="memlake-stream-")
    for _ in range(2):  # the second run finds nothing new
        stream_ingest(spark, folder, work + "/store", work + "/checkpoint", NOW, files_per_batch=1).awaitTermination()
    batch = newest(read_archive(spark, folder))
    columns = ["session_id", "seq", "timestamp_ms", "content"]
    assert rows(current(spark, work + "/store", "turns"), *columns) == rows(build_turns(batch.turns), *columns)
    put(folder, "2026/04/12/again.jsonl", header("aaaaaaaa-1", version=NOW), turn(1, "resaved"))
    stream_ingest(spark, folder, work + "/store", work + "/checkpoint", NOW).awaitTermination()
    assert rows(current(spark, work + "/store", "turns").where("session_id = 'aaaaaaaa-1'"), "content") == [("resaved",)]
    assert rows(current(spark, work + "/store", "sessions"), "session_id", "turn_count") == [("aaaaaaaa-1", 1), ("aaaaaaaa-2", 1)]


def test_a_running_stream_merges_its_batches(spark):
    """Nine batches of one file, three versions of each session: what is current equals one batch, few folders are open."""
    folder, work = tempfile.mkdtemp(prefix="memlake-archive-"), tempfile.mkdtemp(prefix="memlake-stream-")
    for version in range(3):
        for name in "abc":
            put(folder, f"{version}{name}.jsonl", header(name, f"2026-04-1{version}T00:00:00Z"), *[turn(i, f"{name}{version}") for i in range(1, 4 - version)], "{bad")
            os.utime(os.path.join(folder, f"{version}{name}.jsonl"), (1_000_000 + 100 * version + ord(name),) * 2)
    stream_ingest(spark, folder, f"{work}/merged", f"{work}/c1", NOW, 1, merge_every=2).awaitTermination()
    stream_ingest(spark, folder, f"{work}/whole", f"{work}/c2", NOW, 100).awaitTermination()
    for table, columns in (("sessions", ["session_id", "start_ts", "turn_count"]), ("turns", ["session_id", "seq", "content"])):
        assert rows(current(spark, f"{work}/merged", table), *columns) == rows(current(spark, f"{work}/whole", table), *columns)
        assert log_folders(spark, f"{work}/merged/{table}") == [(0, 7), (8, 8)]
    assert current(spark, f"{work}/merged", "errors").count() == 9
    # What merges replaced goes after one more round; a merge that was cut short is not read, and done again.
    left = {name for name in os.listdir(f"{work}/merged/turns") if "=" in name}
    assert "batch_id=0" not in left and "merged=0-3" not in left and "merged=0-7" in left
    os.remove(f"{work}/merged/turns/merged=0-7/_SUCCESS")
    assert (0, 7) not in log_folders(spark, f"{work}/merged/turns")


def test_merges_of_levels():
    assert [due_merge(i, 2) for i in range(8)] == [0, 2, 0, 4, 0, 2, 0, 8] and [due_merge(i, 10) for i in (8, 9, 98, 99, 999)] == [0, 10, 0, 100, 1000]


def test_merging_again_changes_nothing(spark):
    folder, work = sample(), tempfile.mkdtemp(prefix="memlake-stream-")
    stream_ingest(spark, folder, f"{work}/s", f"{work}/c", NOW, 1, merge_every=10).awaitTermination()
    before = rows(current(spark, f"{work}/s", "turns"), "session_id", "content")
    for _ in range(2):
        merge_batches(spark, f"{work}/s", 0, 3, 2)
        assert rows(current(spark, f"{work}/s", "turns"), "session_id", "content") == before
    # Batches that ran again after their merge are in it already.
    assert len(log_folders(spark, f"{work}/s/turns")) == 1


def test_a_block_is_judged_once(spark):
    """Not once per line: a long session would take the square of its length."""
    plan = ar.read_lines(spark, sample())._jdf.queryExecution().optimizedPlan().toString().split("\n")
    last = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    judged = [i for i, line in enumerate(plan) if "block_ok" in line and "exists(" in line]
    assert judged and min(judged) > last


def test_a_batch_of_single_versions_is_not_shuffled(spark, monkeypatch):
    """A stream of many small batches: what a batch costs besides its rows counts as often as there are batches."""
    plans = {}

    def noted(df, path, batch_id):
        plans.setdefault(os.path.basename(path), []).append(df._jdf.queryExecution().executedPlan().toString())
        append_batch(df, path, batch_id)

    monkeypatch.setattr(streamed, "append_batch", noted)
    folder, work = tempfile.mkdtemp(prefix="memlake-archive-"), tempfile.mkdtemp(prefix="memlake-stream-")
    for name in "abc":
        put(folder, f"{name}.jsonl", header(name), *[turn(i, f"{name}{i}") for i in range(1, 4)])
    stream_ingest(spark, folder, f"{work}/s", f"{work}/c", NOW).awaitTermination()
    assert rows(current(spark, f"{work}/s", "turns"), "content") == [(f"{name}{i}",) for name in "abc" for i in range(1, 4)]
    assert rows(current(spark, f"{work}/s", "sessions"), "session_id", "turn_count") == [("a", 3), ("b", 3), ("c", 3)]
    assert set(plans) == {"sessions", "turns", "errors"}
    assert not any("hashpartitioning" in plan for table in plans.values() for plan in table)
    for table in plans:
        assert len([name for name in os.listdir(f"{work}/s/{table}/batch_id=0") if name.endswith(".parquet")]) <= 1
    # A batch that may hold large files gives the same rows.
    monkeypatch.setattr(streamed, "WHOLE_FILE_BYTES", 0)
    stream_ingest(spark, folder, f"{work}/large", f"{work}/c2", NOW).awaitTermination()
    for table in ("sessions", "turns"):
        assert rows(current(spark, f"{work}/large", table)) == rows(current(spark, f"{work}/s", table))


@pytest.mark.parametrize("sent", [streamed.SENT_SESSIONS, 0])
def test_rows_of_replaced_versions_go(spark, monkeypatch, sent):
    monkeypatch.setattr(streamed, "SENT_SESSIONS", sent)
    data = [("p", "a", 1, "x", 1), ("p", "a", 2, "x", 2), ("p", "a", 2, "y", 3), ("p", "a", 2, "y", 3), ("q", "a", 1, "x", 4), ("p", "b", 5, "x", 5), ("p", "b", 5, "x", 6)]
    table = spark.createDataFrame(data, "profile_id string, session_id string, version long, version_file string, n int")
    kept = streamed.only_newest(table)(table)
    assert kept.columns == table.columns
    assert rows(kept) == rows(latest_version(table, ["profile_id", "session_id"], ["version", "version_file"]))
    assert rows(kept, "n") == [(3,), (3,), (4,), (5,), (6,)]
    single = table.where("n > 3")
    assert streamed.only_newest(single)(single) is single
