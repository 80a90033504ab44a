"""Archive against store by content, and single turns looked up in a store."""

import random
import tempfile

import pytest
from conftest import rows
from test_archive import NOW
from test_store import archive_of, built, saved, session

from memlake.operators import content
from memlake.operators.content import content_differences, group_digests, unequal_groups
from memlake.operators.filters import lookup_turns
from memlake.plans.rebuild import dated_turns, newest
from memlake.plans.search import search
from memlake.sources.archive import read_archive
from memlake.sources.tables import read_by_profile, write_by_profile

SCHEMA = "profile_id string, day string, session_id string, seq long, role string, timestamp_ms long, content string"


def turn(profile, day, name, seq, text, role="user", time=5):
    return profile, day, name, seq, role, time, text


BASE = [turn(p, f"d{d}", f"s{d}", i, f"text {i}") for p in ("pA", "pB") for d in range(4) for i in range(3)]


def frames(spark, archived, stored):
    return spark.createDataFrame(archived, SCHEMA), spark.createDataFrame(stored, SCHEMA)


def brute(archived, stored):
    """By dictionaries: (profile, session, seq) to all that is held under it."""
    sides = []
    for table in (archived, stored):
        held = {}
        for p, day, name, seq, *rest in table:
            held.setdefault((p, name, seq), []).append((day, tuple(rest)))
        sides.append({key: (sorted(map(repr, (r for _, r in own))), min(repr(d) for d, _ in own)) for key, own in held.items()})
    ours, theirs = sides
    out = []
    for key in ours.keys() | theirs.keys():
        a, b = ours.get(key), theirs.get(key)
        if a and b:
            if a != b:
                out.append((*key, "changed" if a[0] != b[0] else "regrouped", None))
            continue
        missing = a is not None
        other = [k[0] for k, v in (theirs if missing else ours).items() if k[1:] == key[1:] and v[0] == (a or b)[0] and k not in (ours if missing else theirs)]
        kind = ("moved" if missing else "arrived") if other else "missing" if missing else "added"
        out.append((*key, kind, min(other) if other else None))
    return sorted(out, key=repr)


def found(spark, archived, stored):
    return sorted((tuple(r) for r in content_differences(*frames(spark, archived, stored)).collect()), key=repr)


def test_every_kind_is_named(spark):
    stored = [r for r in BASE if r[:4] != ("pA", "d0", "s0", 1)]
    stored = [turn(*r[:4], "other") if r[:4] == ("pA", "d1", "s1", 2) else r for r in stored]
    stored = [("pA", "later", *r[2:]) if r[:4] == ("pA", "d2", "s2", 0) else r for r in stored]
    archived = [*BASE, turn("pA", "d3", "x", 0, "moves")]
    stored += [turn("pC", "d3", "x", 0, "moves"), turn("pC", "d3", "y", 0, None)]
    assert found(spark, archived, stored) == sorted(
        [
            ("pA", "s0", 1, "missing", None), ("pA", "s1", 2, "changed", None), ("pA", "s2", 0, "regrouped", None),
            ("pA", "x", 0, "moved", "pC"), ("pC", "x", 0, "arrived", "pA"), ("pC", "y", 0, "added", None),
        ],
        key=repr,
    )
    groups = rows(unequal_groups(*frames(spark, archived, stored)), "profile_id", "day", "n_archived", "n_stored")
    assert {g[:2] for g in groups} == {("pA", "d0"), ("pA", "d1"), ("pA", "d2"), ("pA", "later"), ("pA", "d3"), ("pC", "d3")}


def test_equal_in_any_order_and_partitioning(spark):
    a, b = frames(spark, BASE, BASE[::-1])
    assert unequal_groups(a, b.repartition(5)).isEmpty() and content_differences(a, b).isEmpty()
    empty = a.limit(0)
    assert content_differences(empty, empty).isEmpty() and group_digests(empty).isEmpty()
    assert {r["kind"] for r in content_differences(a, empty).collect()} == {"missing"}


def test_null_is_not_empty_and_borders_count(spark):
    archived = [turn("p", "d", "s", 0, None), turn("p", "d", "s", 1, "ab", "c"), turn(None, None, None, None, "x")]
    stored = [turn("p", "d", "s", 0, ""), turn("p", "d", "s", 1, "b", "ca"), turn(None, None, None, None, "x")]
    assert [r[2:4] for r in found(spark, archived, stored)] == [(0, "changed"), (1, "changed")]
    assert [r[3] for r in found(spark, archived[2:], [turn(None, None, None, None, "y")])] == ["changed"]


@pytest.mark.parametrize("literal", [0, 200])
@pytest.mark.parametrize("seed", range(3))
def test_random_tables_equal_brute_force(spark, monkeypatch, literal, seed):
    """Beyond the literal limit the groups are joined. Some rows occur twice, some values are null."""
    monkeypatch.setattr(content, "LITERAL_GROUPS", literal)
    draw = random.Random(seed)

    def table():
        return [
            turn(draw.choice(["a", "b", "c", None]), draw.choice(["1", "2", None]), draw.choice("st"), draw.randrange(4), draw.choice(["x", "y", "", None]))
            for _ in range(30)
        ]

    common = table()
    archived, stored = common + table()[:6], common + table()[:6]
    # The digest reads all rows of the unequal groups only: a key that lies in several groups is compared there.
    ours = found(spark, archived, stored)
    differing = {g[:2] for g in rows(unequal_groups(*frames(spark, archived, stored)), "profile_id", "day")}
    assert ours == brute([r for r in archived if r[:2] in differing], [r for r in stored if r[:2] in differing])


def test_a_store_after_a_save(spark):
    first = [session(f"s{i}", i + 1, f"red {i}", "blue") for i in range(6)]
    store = built(spark, first)
    archived = dated_turns(newest(read_archive(spark, archive_of(spark, first))).turns)
    assert content_differences(archived, store.turns(spark)).isEmpty()
    saved(spark, store, [session("s1", 2, "fresh", "blue"), session("n", 2, "new")], NOW + 1)
    kinds = rows(content_differences(archived, store.turns(spark)).select("session_id", "seq", "kind"))
    assert [(k[0], k[2]) for k in kinds] == [("n", "added"), ("s1", "changed")]


def scanned(df):
    """Rows that the scan gave out, after the row groups it skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_lookup_reads_the_row_groups_of_the_ids_only(spark):
    """Ids are spread like hashes: every row group holds small and large ones."""
    path = tempfile.mkdtemp(prefix="memlake-lookup-")
    table = spark.range(40_000).selectExpr("xxhash64(id) AS turn_id", "id AS timestamp_ms", "concat('p', id % 20) AS profile_id")
    write_by_profile(table, f"{path}/t", ["timestamp_ms"], lookup="turn_id")
    table.repartition(20, "profile_id").write.option("parquet.enable.dictionary", "false").partitionBy("profile_id").parquet(f"{path}/plain")
    stored, plain = read_by_profile(spark, f"{path}/t"), read_by_profile(spark, f"{path}/plain")
    for n in (1, 12, 100):
        ids = [r["turn_id"] for r in stored.where("profile_id = 'p7'").limit(n).collect()]
        found = lookup_turns(stored, ids)
        assert sorted(r["turn_id"] for r in found.collect()) == sorted(ids)
        # A twentieth of the rows, and what the filters let through wrongly.
        assert scanned(found) <= n // 10 * 2_000 + 6_000 and scanned(lookup_turns(plain, ids)) == 40_000
    assert lookup_turns(stored, []).isEmpty()


def test_search_at_once(spark):
    store = built(spark, [session(f"s{i}", i + 1, f"red {'blue ' * i}", "gold") for i in range(6)])
    queries = spark.createDataFrame([(1, "red"), (2, "gold"), (3, "nothing")], "query_id long, text string")
    args = store.turns(spark), queries, store.index(spark)
    late, now = (rows(search(*args, mode="keyword", at_once=x)) for x in (False, True))
    assert late and late == now
    assert search(store.turns(spark), queries.limit(0), store.index(spark), mode="keyword", at_once=True).isEmpty()
