"""Saving into a store: the tables and the index equal a rebuild, and only what a save touches is written."""

import os
import tempfile

import pytest
from conftest import rows
from test_archive import NOW, header, put, turn

from memlake.operators import keyword as kw
from memlake.plans import rebuild
from memlake.plans.rebuild import Store, finish_save, rebuild_index, save_sessions
from memlake.sources import tables
from memlake.sources.archive import read_archive

WORDS = "red green blue cyan pink gold grey teal"


def session(name, day, *texts, profile="p"):
    return [header(name, f"2026-04-{day:02}T10:00:00Z", profile_id=profile), *[turn(i, t) for i, t in enumerate(texts, 1)]]


# What the archive holds at first, and the sessions of three saves: changed, moved to another day, emptied, new.
FIRST = [session(f"s{i}", i + 1, f"{WORDS} {'red ' * i}", f"only{i} blue") for i in range(8)] + [session("s0", 3, "other red", profile="q/ü=1")]
SAVES = [
    [session("s1", 2, "fresh red words"), session("s2", 20, "moved green", "again red")],
    [session("s1", 2, "fresh red words", "and blue"), session("s3", 4), session("n1", 2, "new gold session", profile="new")],
    [session("s2", 3, "moved back red"), session("s0", 3, "other gold", profile="q/ü=1"), session("s1", 2)],
]
QUERIES = [(1, "red"), (2, "red blue"), (3, "moved red"), (4, "only1"), (5, "fresh"), (6, "gold"), (7, "again")]


def archive_of(spark, sessions):
    folder = tempfile.mkdtemp(prefix="memlake-archive-")
    for i, lines in enumerate(sessions):
        put(folder, f"{i}.jsonl", *lines)
    return folder


def built(spark, sessions):
    store = Store(tempfile.mkdtemp(prefix="memlake-store-") + "/s")
    rebuild_index(spark, archive_of(spark, sessions), store.path, NOW, buckets=3)
    return store


def saved(spark, store, sessions, now=NOW + 1):
    return save_sessions(spark, store, read_archive(spark, archive_of(spark, sessions)), now)


def latest(*rounds):
    found = {}
    for sessions in rounds:
        for lines in sessions:
            found[lines[0]["profile_id"], lines[0]["session_id"]] = lines
    return list(found.values())


def content(spark, store, searched=False):
    """Everything a reader can see, for all profiles and for each."""
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    out = {
        "turns": rows(store.turns(spark).drop("file_path")),
        "sessions": rows(store.sessions(spark), "profile_id", "session_id", "start_ts", "turn_count", "day"),
        "vectors": [(r["turn_id"], list(r["q8"])) for r in store.vectors(spark).orderBy("turn_id").collect()],
    }
    for profile in (None, "p", "q/ü=1", "new"):
        index = store.index(spark, profile)
        out[profile] = [rows(index.term_stats, "bucket", "term", "df"), rows(index.corpus)]
    index = store.index(spark)
    out["postings"] = rows(index.postings, "term", "turn_id", "tf", "dl", "positions")
    if searched:
        out["hits"] = rows(kw.keyword_search(index, queries, 9))
        out["phrases"] = rows(kw.phrase_search(index, queries, 9))
        banned = spark.createDataFrame([(1, "gold")], "query_id long, text string")
        out["own"] = rows(kw.keyword_search(store.index(spark, "p"), queries, 9, exclude=banned))
        out["prefixes"] = rows(kw.prefix_search(store.index(spark, "p"), queries, 9))
    return out


def files(path):
    """Every data file with its time and size."""
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                whole = os.path.join(folder, name)
                found[os.path.relpath(whole, path)] = (os.stat(whole).st_mtime_ns, os.path.getsize(whole))
    return found


def test_three_saves_equal_a_rebuild(spark):
    store = built(spark, FIRST)
    for sessions in SAVES:
        before = files(store.path)
        saved(spark, store, sessions)
        after = files(store.path)
        index = [name for name in before if name.split("/")[0] in ("postings", "term_stats", "corpus", "deleted", "errors")]
        assert all(after[name] == before[name] for name in index), "no old segment is written again"
    expected = content(spark, built(spark, latest(FIRST, *SAVES)), True)
    assert content(spark, store, True) == expected
    kw.merge_segments(spark, store.path)
    assert store.index(spark).term_parts is None and content(spark, store, True) == expected
    saved(spark, store, SAVES[0])
    assert content(spark, store) == content(spark, built(spark, latest(FIRST, *SAVES, SAVES[0])))


def test_a_save_writes_the_touched_folders_only(spark):
    store = built(spark, FIRST)
    before = files(store.path)
    saved(spark, store, SAVES[0])
    after = files(store.path)
    touched = ("profile_id=p/day=2026-04-02", "profile_id=p/day=2026-04-03", "profile_id=p/day=2026-04-20")
    changed = {name for name in before.keys() | after.keys() if before.get(name) != after.get(name)}
    tables = {name for name in changed if name.split("/")[0] in rebuild.TABLES}
    assert tables and all(any(folder in name for folder in touched) for name in tables)
    assert all("segment=1/" in name or "save=1/" in name for name in changed - tables)
    # Session s2 was alone on its day: the folder is gone with it.
    assert not any("profile_id=p/day=2026-04-03" in name for name in after)
    assert not os.path.exists(f"{store.path}/pending")


@pytest.mark.parametrize("calls", [0, 2])
def test_a_save_cut_short_is_carried_out_later(spark, monkeypatch, calls):
    whole, cut = built(spark, FIRST), built(spark, FIRST)
    saved(spark, whole, SAVES[0])
    write, left = rebuild.write_by_profile, [calls]

    def failing(*args, **more):
        if not left[0]:
            raise OSError("lost")
        left[0] -= 1
        write(*args, **more)

    monkeypatch.setattr(rebuild, "write_by_profile", failing)
    with pytest.raises(OSError):
        saved(spark, cut, SAVES[0])
    monkeypatch.undo()
    if calls == 2:
        # The next save finishes it first.
        saved(spark, whole, SAVES[1])
        saved(spark, cut, SAVES[1])
    else:
        finish_save(spark, cut)
    assert content(spark, cut) == content(spark, whole)


def test_a_save_that_was_not_staged_is_given_up(spark, monkeypatch):
    store = built(spark, FIRST)
    before = content(spark, store)
    monkeypatch.setattr(rebuild, "next_segment", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        saved(spark, store, SAVES[0])
    monkeypatch.undo()
    assert content(spark, store) == before
    finish_save(spark, store)
    assert not os.path.exists(f"{store.path}/pending") and content(spark, store) == before


def test_first_seen_and_shared_ids(spark):
    store = built(spark, FIRST)
    saved(spark, store, SAVES[0], NOW + 5)
    times = {r["session_id"]: (r["created_at"], r["updated_at"]) for r in store.sessions(spark).where("profile_id = 'p'").collect()}
    assert times["s1"] == times["s2"] == (NOW, NOW + 5) and times["s4"] == (NOW, NOW)
    taken = store.turns(spark).where("session_id = 's4'").limit(1)
    with pytest.raises(ValueError, match="two turns have the id"):
        rebuild._check_new_ids(store.turns(spark), taken.withColumn("session_id", taken["preview"]))


def test_many_touched_folders(spark, monkeypatch):
    """Beyond the literal limit the folders are joined."""
    monkeypatch.setattr(rebuild, "LITERAL_FOLDERS", 1)
    store = built(spark, FIRST)
    saved(spark, store, SAVES[0])
    monkeypatch.undo()
    assert content(spark, store) == content(spark, built(spark, latest(FIRST, SAVES[0])))



def stage_tasks(spark, group, run):
    """Tasks of every stage of the jobs that ``run`` starts."""
    spark.sparkContext.setJobGroup(group, group)
    run()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    return [info.numTasks for info in map(tracker.getStageInfo, stages) if info]


def test_many_folders_are_listed_by_few_tasks_and_written_by_many(spark):
    days = spark.range(400).selectExpr("'p' AS profile_id", "cast(date_add(date'2026-01-01', cast(id % 100 AS int)) AS string) AS day", "id AS timestamp_ms")
    path = tempfile.mkdtemp(prefix="memlake-days-") + "/t"
    tables.write_by_profile(days, path, ["timestamp_ms"], by=rebuild.FOLDER, many=True)
    before = spark.conf.get(tables.LISTING_TASKS)
    read = []
    tasks = stage_tasks(spark, "listing", lambda: read.append(tables.read_by_profile(spark, path)))
    assert tasks and max(tasks) <= spark.sparkContext.defaultParallelism and spark.conf.get(tables.LISTING_TASKS) == before
    assert rows(read[0], "profile_id", "day", "timestamp_ms") == rows(days)
    # Each of the four tasks has its own folders, but for those at the borders.
    names = [name.split("part-")[1][:5] for name in files(path)]
    assert len(set(names)) == 4 and len(names) <= 103 and max(map(names.count, names)) < 40


def test_rows_of_one_folder_and_time_are_dealt_to_all_tasks(spark):
    alike = spark.range(4000).selectExpr("'p' AS profile_id", "'2026-01-01' AS day", "7L AS timestamp_ms", "id")
    path = tempfile.mkdtemp(prefix="memlake-day-") + "/t"
    tables.write_by_profile(alike, path, ["timestamp_ms"], by=rebuild.FOLDER, many=True)
    assert len(files(path)) == 4 and tables.read_by_profile(spark, path).count() == 4000
