"""What keyword search moves between tasks: texts, not their words; of stored postings only those that are looked for."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from memlake.operators import keyword as kw
from memlake.operators import vector as vec
from memlake.plans.search import SearchFilter, semantic_hits
from memlake.session import fresh_path


def plan_of(df):
    """The nodes of the plan, without their arguments' line breaks."""
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def queries_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


def test_words_of_a_turn_are_never_sorted_across_rows(spark):
    turns = spark.createDataFrame([(1, "b a b"), (2, "a"), (3, ""), (4, " .,")], "turn_id long, content string")
    postings = kw.build_postings(turns)
    nodes = [line.split("(")[0].lstrip(" +-:") for line in plan_of(postings)]
    words = next(i for i, node in enumerate(nodes) if "Generate" in node)
    assert not any(name in node for node in nodes[:words] for name in ("Aggregate", "Sort", "Exchange"))
    assert rows(postings, "turn_id", "term", "dl", "tf", "positions") == [(1, "a", 3, 1, [1]), (1, "b", 3, 2, [0, 2]), (2, "a", 1, 1, [0])]


def test_rows_of_one_id_are_one_turn_if_they_are_alike(spark):
    """The rows of an id, null among them, that share length and carried columns count as one."""
    data = [(1, "p", "x y"), (1, "p", "y x"), (1, "q", "x y"), (1, "p", "x"), (None, "p", "x x"), (None, "p", "x z")]
    turns = spark.createDataFrame(data, "turn_id long, profile_id string, content string")
    expected = [
        (1, "p", "x", 1, 1, [0]), (1, "p", "x", 2, 2, [0, 1]), (1, "p", "y", 2, 2, [0, 1]), (1, "q", "x", 2, 1, [0]), (1, "q", "y", 2, 1, [1]),
        (None, "p", "x", 2, 3, [0, 0, 1]), (None, "p", "z", 2, 1, [1]),
    ]
    found = rows(kw.build_postings(turns, carry=("profile_id",)), "turn_id", "profile_id", "term", "dl", "tf", "positions")
    assert found == sorted(expected, key=repr)


@pytest.fixture
def stored(spark):
    """A stored index, joins with which are not broadcast for their small size."""
    texts = [(i, f"the word{i} of word{i % 7} then thus") for i in range(60)]
    path = fresh_path(spark, "index")
    kw.build_index(spark.createDataFrame(texts, "turn_id long, content string")).write(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield kw.KeywordIndex.read(spark, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def dealt_by_term(df):
    """Joins for which the stored postings are dealt out by bucket and term."""
    return [line for line in plan_of(df) if "SortMergeJoin" in line and "[bucket#" in line]


def test_postings_of_many_query_terms_stay_where_they_are(spark, stored, monkeypatch):
    queries = queries_of(spark, "the word3", "of word5 then", "word9")
    expected = rows(kw.keyword_search(stored, queries, 5))
    monkeypatch.setattr(kw, "LITERAL_TERMS", 0)
    found = kw.keyword_search(stored, queries, 5)
    assert not dealt_by_term(found) and rows(found) == expected
    # More candidate rows than are sent along: only postings of candidate turns are dealt out.
    monkeypatch.setattr(kw, "BROADCAST_CANDIDATES", 40)
    found = kw.keyword_search(stored, queries, 5)
    assert not dealt_by_term(found) and rows(found) == expected
    assert any("BroadcastHashJoin [turn_id#" in line and "LeftSemi" in line for line in plan_of(found))


def test_a_prefix_needs_no_list_of_its_words(spark, stored, monkeypatch):
    found = kw._begin_with(*kw.settled(kw._prefix_queries(queries_of(spark, "th", "of wor")), 9, "asked"), stored.postings)
    assert not dealt_by_term(found) and not any("SortMergeJoin" in line for line in plan_of(found))
    # More words than are told to a scan: neither the words nor their places are looked up for a plain prefix.
    monkeypatch.setattr(kw, "_posted", None)
    assert rows(kw.prefix_search(stored, queries_of(spark, "th", "of wor", "zz"), 2), "query_id", "rank") == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_prefixes_beyond_those_told_to_the_scan(spark, stored, monkeypatch):
    queries = queries_of(spark, "th", "of wor", "word1 t", "zz")
    expected = rows(kw.prefix_search(stored, queries, 5, F.col("turn_id") > 9))
    monkeypatch.setattr(kw, "FILTER_TERMS", 0)
    assert rows(kw.prefix_search(stored, queries, 5, F.col("turn_id") > 9)) == expected and len(expected) > 10


def test_filtered_vectors_are_compared_by_many_tasks(spark):
    """Joined with their turns they are few bytes, which Spark would put into one task."""
    turns = spark.createDataFrame([(i, "en" if i % 3 else "de", 0) for i in range(200)], "turn_id long, role string, timestamp_ms long")
    vectors = spark.createDataFrame([(i, [float(i % 17), 1.0]) for i in range(200)], "turn_id long, embedding array<float>")
    stored, queries = vec.quantized(vectors).select("turn_id", "q8"), spark.createDataFrame([(1, [0, 1])], "query_id long, q8 array<tinyint>")
    tasks = []
    with pytest.MonkeyPatch.context() as patch:
        found = vec.knn
        patch.setattr("memlake.plans.search.knn", lambda kept, *a: tasks.append(kept.select(F.spark_partition_id()).distinct().count()) or found(kept, *a))
        for filters in (SearchFilter(role="en"), SearchFilter(profile="p")):
            with_profile = turns.withColumn("profile_id", F.when(F.col("role") == "en", "p"))
            hits = semantic_hits(with_profile, stored, queries, 50, filters, "pre")
            assert hits.count() == 50 and hits.where(F.col("turn_id") % 3 == 0).count() == 0
    assert tasks == [4, 4]


def vectors_and_queries(spark, stored, asked):
    vectors = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(stored)], "turn_id long, q8 array<tinyint>")
    return vectors, spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(asked)], "query_id long, q8 array<tinyint>")


def test_a_query_gets_few_rows_of_each_task(spark):
    """Not k rows of every group of vectors: their number grew with the groups, most of them far away."""
    rng = np.random.default_rng(3)
    vectors, queries = vectors_and_queries(spark, rng.integers(-127, 128, (600, 24)), rng.integers(-127, 128, (50, 24)))
    assert vec._knn_blocks(vectors, queries, 4, "l2", vec.BLOCK_VECTORS, vec.BLOCK_QUERIES).count() == 4 * 50


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("width, tasks", [(16, 100_000), (16, 2), (300, 100_000)])
def test_blocks_of_neighbours_equal_carried_queries(spark, monkeypatch, metric, width, tasks):
    """Bounds that are drawn in while a task reads, several tasks in a partition, products beyond float32; copies, zero vectors, few values."""
    monkeypatch.setattr(vec, "MOST_TASKS", tasks)
    monkeypatch.setattr(vec, "SAMPLE_VECTORS", 20)
    monkeypatch.setattr(vec, "CENTRES", 5)
    monkeypatch.setattr(vec, "FRESH_ROWS", 10)
    monkeypatch.setattr(vec, "NEAR_TILE", 16)
    rng = np.random.default_rng(width)
    stored = rng.integers(-1, 2, (500, width)) * rng.choice([1, 60, 127], (500, 1))
    asked = np.concatenate([stored[:40], rng.integers(-127, 128, (30, width)), np.full((1, width), -128)])
    stored[300:400], stored[7], stored[9], asked[3] = stored[300], 0, 127, 0
    vectors, queries = vectors_and_queries(spark, stored, asked)
    queries = queries.unionByName(queries.where("query_id < 3"))  # ids may repeat
    vectors = vectors.unionByName(vectors.where("turn_id < 5"))
    columns = ["query_id", "rank", "distance"]
    carried, blocks = (rows(vec.knn(vectors, queries, 6, metric, n, 130, 20), *columns, "turn_id") for n in (1000, 0))
    assert blocks == carried and len(blocks) == 71 * 6
    assert not rows(vec.knn(vectors.limit(0), queries, 6, metric, 0))
    assert rows(vec.knn(vectors, queries, 30, metric, 0), *columns) == rows(vec.knn(vectors, queries, 30, metric, 1000), *columns)
