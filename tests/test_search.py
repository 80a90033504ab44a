import hashlib
import math
import os
import random

import numpy as np
import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from memlake import session
from memlake.operators import keyword as kw
from memlake.operators import vector as vec
from memlake.operators.hybrid import rrf_fuse
from memlake.operators.ranking import row_numbers, running_counts, skewed_join, top_by_quota, top_k
from memlake.plans import fixtures as fx
from memlake.plans.search import SearchFilter, search
from memlake.session import fresh_path

TURNS = "turn_id long, session_id string, seq int, timestamp_ms long, role string, content string, preview string"


def turns_of(spark, *texts):
    data = [(i, "s", i, 1000 * i, "user" if i % 2 else "tool_call", t, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(data, TURNS)


def queries_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


@pytest.fixture(scope="module")
def corpus(spark):
    return turns_of(spark, "Rust is a systems language", "Learning rust by doing", "Rust and 数据湖 again: rust!", "nothing", None)


def plain_bm25(texts, query, any_term=False):
    docs = {i: t.split() for i, t in texts.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    scores = {}
    for i, words in docs.items():
        hit = [t for t in set(query) if t in words]
        if not hit or (not any_term and len(hit) < len(set(query))):
            continue
        total = 0.0
        for t in hit:
            df = sum(t in w for w in docs.values())
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 0) or 1e-6
            tf = words.count(t)
            total += query.count(t) * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avgdl))
        scores[i] = round(total, 6)
    return scores


def test_keyword_cases(spark, corpus):
    index = kw.build_index(corpus, carry=("timestamp_ms", "role"))
    assert rows(index.corpus) == [(4, 16 / 4 + 0.25)]
    hits = kw.keyword_search(index, queries_of(spark, "Rust", "数据", "据数", "rust zzz", "!!"), 5)
    assert rows(hits, "query_id", "turn_id") == [(1, 1), (1, 2), (1, 3), (2, 3), (3, 3)]
    late = search(corpus, queries_of(spark, "Rust"), index, mode="keyword", filters=SearchFilter(after_ms=2500))
    assert rows(late, "turn_id") == [(3,)]
    assert search(corpus, queries_of(spark, "Rust"), index, mode="keyword", filters=SearchFilter(role="assistant")).count() == 0
    bounds = SearchFilter(after_ms=1000, before_ms=2000)
    assert rows(search(corpus, queries_of(spark, "rust"), index, mode="keyword", filters=bounds), "turn_id") == [(1,), (2,)]
    recent = SearchFilter(after_ms=0, last_days=1, now_ms=86_400_000 + 3000)
    assert rows(search(corpus, queries_of(spark, "rust"), index, mode="keyword", filters=recent), "turn_id") == [(3,)]


def test_filter_after_the_cut(spark, corpus):
    index = kw.build_index(corpus)
    wanted = SearchFilter(role="tool_call")
    found = search(corpus, queries_of(spark, "rust"), index, mode="keyword", k=1, filters=wanted, filter_order="post")
    assert found.count() == 0
    assert search(corpus, queries_of(spark, "rust"), index, mode="keyword", k=1, filters=wanted).count() == 1


@pytest.mark.parametrize("literal,broadcast", [(5_000, 500_000), (5_000, 0), (0, 0)])
def test_bm25_equals_plain(spark, monkeypatch, literal, broadcast):
    """Few and many queries take different ways to the same scores."""
    monkeypatch.setattr(kw, "LITERAL_TERMS", literal)
    monkeypatch.setattr(kw, "BROADCAST_CANDIDATES", broadcast)
    rng = random.Random(3)
    words = ["hot"] * 10 + [f"w{i}" for i in range(15)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(1, 12))) for i in range(1, 120)}
    asked = {q: rng.choices(words, k=rng.randint(1, 3)) for q in range(1, 30)}
    turns = spark.createDataFrame([(i, t) for i, t in texts.items()], "turn_id long, content string")
    queries = spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "query_id long, text string")
    index = kw.build_index(turns)
    for require in ("all", "any"):
        got = {(r.query_id, r.turn_id): r.score for r in kw.keyword_scores(index, queries, require).collect()}
        expected = {(q, i): s for q, t in asked.items() for i, s in plain_bm25(texts, t, require == "any").items()}
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - expected[k]) < 2e-6 for k in got)


def test_phrase_near_prefix_exclude(spark):
    turns = turns_of(spark, "one two three", "two one three", "one x two", "one x y two", "onerous two two two one two")
    index = kw.build_index(turns)

    def found(df):
        return rows(df, "turn_id")

    assert found(kw.phrase_search(index, queries_of(spark, "one two"), 9)) == [(1,), (5,)]
    assert found(kw.phrase_search(index, queries_of(spark, "two two"), 9)) == [(5,)]
    assert found(kw.near_search(index, queries_of(spark, "two one"), 0, 9)) == [(1,), (2,), (5,)]
    assert found(kw.near_search(index, queries_of(spark, "two one"), 1, 9)) == [(1,), (2,), (3,), (5,)]
    assert found(kw.prefix_search(index, queries_of(spark, "Oner"), 9)) == [(5,)]
    assert found(kw.prefix_search(index, queries_of(spark, "on"), 9)) == [(1,), (2,), (3,), (4,), (5,)]
    assert found(kw.keyword_search(index, queries_of(spark, "one"), 9, exclude=queries_of(spark, "x three"))) == [(5,)]
    condition = F.col("turn_id") > 1
    assert found(kw.phrase_search(index, queries_of(spark, "one two"), 9, condition)) == [(5,)]


def test_refresh_equals_rebuild(spark):
    before = turns_of(spark, "a b", "b c", "c d")
    after = turns_of(spark, "a b", "b changed").unionByName(turns_of(spark, "x").withColumn("turn_id", F.lit(9).cast("long")))
    changed = spark.createDataFrame([(2,), (3,), (9,)], "turn_id long")
    old, new = (t.join(changed, "turn_id", "left_semi") for t in (before, after))
    refreshed, built = kw.refresh_index(kw.build_index(before, buckets=32), old, new), kw.build_index(after, buckets=32)
    columns = ["bucket", "term", "turn_id", "tf", "dl", "positions"]
    assert rows(refreshed.postings, *columns) == rows(built.postings, *columns)
    assert rows(refreshed.term_stats, "bucket", "term", "df") == rows(built.term_stats, "bucket", "term", "df")
    assert rows(refreshed.corpus) == rows(built.corpus) and rows(refreshed.sizes) == rows(built.sizes)


def test_top_k_ways_agree(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("x"), "id")
    order = [F.col("x").desc(), F.col("id").asc()]
    few = top_k(df, ["g"], order, 900)
    many = top_k(df, ["g"], order, 1100).where("rank <= 900")
    assert rows(few) == rows(many)
    quota = F.col("g") + 2
    a, b = top_by_quota(df, ["g"], order, quota, 10), top_by_quota(df, ["g"], order, quota, 5000)
    assert rows(a) == rows(b) and a.count() == 2 + 3 + 4


def test_a_hot_key_is_split(spark):
    """One key owns a third of the rows: no task of the join gets more than a few hundredths."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        large = spark.range(0, 90_000, 1, 24).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        small = spark.range(90_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))
        joined = skewed_join(large, small, ["key"], "inner").withColumn("task", F.spark_partition_id())
        shares = [r["count"] / 90_000 for r in joined.groupBy("task").agg(F.count("*").alias("count"), F.max("text")).collect()]
        assert abs(sum(shares) - 1) < 1e-9 and max(shares) < 0.1
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        joined = skewed_join(large, small, ["key"], "inner").withColumn("task", F.spark_partition_id())
        shares = [r["count"] / 90_000 for r in joined.groupBy("task").agg(F.count("*").alias("count"), F.max("text")).collect()]
        assert abs(sum(shares) - 1) < 1e-9 and max(shares) < 0.15
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        for name, value in before.items():
            spark.conf.set(name, value)


def test_excluded_and_prefix_terms_reach_the_scan(spark):
    """Every scan of the stored postings names its buckets and terms."""
    path = fresh_path(spark, "index")
    kw.build_index(turns_of(spark, "one two", "two three", "three four five"), buckets=8).write(path)
    index = kw.KeywordIndex.read(spark, path)
    for found in (
        kw.keyword_scores(index, queries_of(spark, "two"), exclude=queries_of(spark, "three")),
        kw._posted(index, kw._terms_with_prefix(index, kw._prefix_queries(queries_of(spark, "tw"))), index.postings),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "FileScan" in line and "positions" in line or "FileScan" in line and "tf#" in line]
        assert scans and all("bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_a_failing_side_is_left_out(spark):
    def load():
        raise OSError("no model here")

    turns = fx.turns(spark, SF_DIR)
    index = kw.build_index(turns, "content", ("timestamp_ms", "role"))
    stored = vec.quantized(vec.embed_texts(turns.limit(20).select("turn_id", "content"))).select("turn_id", "q8")
    queries = queries_of(spark, "the")
    found = search(turns, queries, index, stored, "hybrid", load_encoder=load, degrade=True)
    alone = search(turns, queries, index, None, "hybrid")
    assert rows(found) == rows(alone) and found.count() == 5
    with pytest.raises(Exception, match="no model here"):
        search(turns, queries, None, stored, "hybrid", load_encoder=load, degrade=True)


def test_scratch_is_dropped(spark):
    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    kept = dict(session._made)
    session._made[spark.sparkContext.applicationId] = [path]
    assert session.drop_scratch(spark) == 1 and not os.path.exists(path)
    session._made.update(kept)


def test_running_counts_of_a_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), (1000 - F.col("id")).alias("t"))
    got = running_counts(df, ["k"], ["t"], {"pos": F.lit(1), "even": F.col("t") % 2 == 0})
    seen = {}
    for k, t, pos, even in sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1])):
        n, e = seen.get(k, (0, 0))
        seen[k] = (n + 1, e + (t % 2 == 0))
        assert (pos, even) == seen[k]
    assert [r[1] for r in rows(row_numbers(df, ["k", "t"], "n").orderBy("n").limit(1), "k", "n")] == [1]


def vectors_of(spark, matrix, key="turn_id"):
    data = [(i, [int(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, f"{key} long, q8 array<tinyint>")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("carried", [1024, 0])
def test_knn_equals_brute_force(spark, metric, carried):
    rng = np.random.default_rng(5)
    stored, asked = rng.integers(-127, 128, (300, 16)), rng.integers(-127, 128, (20, 16))
    stored[100:200] = stored[100]  # a third of all vectors are copies
    asked[0], stored[7] = stored[100], 0
    got = vec.knn(vectors_of(spark, stored), vectors_of(spark, asked, "query_id"), 7, metric, carried, 64, 8)
    for q, row in enumerate(asked):
        if metric == "l2":
            distance = np.sqrt(((stored - row) ** 2).sum(1))
        else:
            norms = np.linalg.norm(stored, axis=1) * np.linalg.norm(row)
            distance = 1 - np.where(norms > 0, stored @ row / np.where(norms > 0, norms, 1), 0)
        expected = sorted((round(float(d), 6), i) for i, d in enumerate(distance))[:7]
        found = [(round(r.distance, 6), r.turn_id) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()]
        assert [i for _, i in found] == [i for _, i in expected]
        assert np.allclose([d for d, _ in found], [d for d, _ in expected], atol=2e-6)


def test_identical_vector_scores_one(spark):
    stored = vectors_of(spark, [[1, 2], [3, 4]])
    hit = vec.knn(stored, vectors_of(spark, [[3, 4]], "query_id"), 1).select("turn_id", vec.semantic_score()).first()
    assert tuple(hit) == (1, 1.0)


def test_mean_pool_mask(spark):
    data = [("a", [1.0, 3.0], 1), ("a", [3.0, 5.0], 1), ("a", [100.0, 100.0], 0), ("b", [9.0, 9.0], 0)]
    pooled = vec.mean_pool(spark.createDataFrame(data, "id string, vector array<double>, mask int"), ["id"], "vector", "mask")
    assert rows(pooled) == [("a", [2.0, 4.0]), ("b", [0.0, 0.0])]


def test_hashed_encoder_equals_counts(spark):
    turns = turns_of(spark, "one two two", "two TWO one", "", "alone")
    got = {r.turn_id: r.embedding for r in vec.embed_texts(turns.select("turn_id", "content"), dimensions=32).collect()}
    slot = {t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 32 for t in ("one", "two", "alone")}
    expected = np.zeros(32)
    expected[slot["one"]] += 1
    expected[slot["two"]] += 2
    assert np.allclose(got[1], expected / np.linalg.norm(expected), atol=1e-6)
    assert got[1] == got[2] and not any(got[3]) and got[4][slot["alone"]] == 1.0


def test_own_encoder_gets_prefixed_texts(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0 if t.startswith("query: ") else 0.0] for t in texts])

    got = vec.embed_texts(turns_of(spark, "abc").select("turn_id", "content"), load).first().embedding
    assert np.allclose(got, np.array([10.0, 1.0]) / math.sqrt(101))


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, turn_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, turn_id long, rank int")
    fused = [tuple(r) for r in rrf_fuse([a, b], 3).orderBy("rank").select("turn_id", "score").collect()]
    assert fused == [(11, round(1 / 61 + 1 / 62, 6)), (10, round(1 / 61, 6)), (12, round(1 / 62, 6))]


def test_hybrid_without_vectors_is_keyword(spark, corpus):
    index, queries = kw.build_index(corpus), queries_of(spark, "rust")
    words = search(corpus, queries, index, mode="keyword")
    assert rows(search(corpus, queries, index), "turn_id", "rank") == rows(words, "turn_id", "rank")
    with pytest.raises(ValueError):
        search(corpus, queries, index, mode="semantic")


def test_text_search_equals_brute_force(spark):
    turns = fx.document_turns(spark, SF_DIR)
    stored = vec.quantized(vec.embed_texts(turns.select("turn_id", "content"))).select("turn_id", "q8")
    asked = fx.benchmark_queries(spark, SF_DIR)
    got = search(turns, asked, vectors=stored, mode="semantic", k=3)
    matrix = stored.orderBy("turn_id").toPandas()
    vectors = np.array(matrix["q8"].tolist(), dtype=int)
    for r in vec.quantized(vec.embed_texts(asked, text="text")).collect():
        distance = np.round(np.sqrt(((vectors - np.array(r.q8, dtype=int)) ** 2).sum(1)), 6)
        expected = [int(matrix["turn_id"][i]) for i in np.lexsort((matrix["turn_id"], distance))[:3]]
        found = [h.turn_id for h in got.where(F.col("query_id") == r.query_id).orderBy("rank").collect()] if r.query_id < 5 else None
        assert found is None or found == expected
