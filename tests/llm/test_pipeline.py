"""The pipeline's stages against plain versions."""

import random

from pyspark.sql import functions as F
from test_near_duplicates import brute
from test_scanners import ITEM, plain_tiles

import corpus_pipeline
from memlake.llm import rank_profiles
from memlake.llm.secrets import find_secrets, redacted, scanner
from memlake.llm.tiling import words_of

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "encode":
            assert out.columns == docs.columns
        found = {r["doc_id"]: r.asDict() for r in out.collect()}
        if name == "language_id":
            assert set(found) == {i for i, r in rows.items() if any(c.isalpha() for c in r["text"])}
        elif name == "near_dedup":
            named = brute([(i, r["text"]) for i, r in rows.items()], 5)
            assert set(found) == {i for i, (_, component) in named.items() if component == i}
        elif name == "decontaminate":
            items = [words_of(t) for t in benchmark]
            held = lambda t: any(
                sum(k for *_, k in plain_tiles(a, t, 5)) * 100 >= 80 * len(a) for a in items if set(a) & set(t) and len(set(a) & set(t)) * 2 >= len(set(a))
            )
            assert set(found) == {i for i, r in rows.items() if not held(words_of(r["text"]))}
        elif name == "remove_secrets":
            for i, r in rows.items():
                clean = redacted(r["text"], find_secrets(scanner(), r["text"]), "[SECRET]")
                assert found[i]["text"] == clean and found[i]["n_chars"] == len(clean)
        else:
            assert set(found) == set(rows) and all(r["round_trip"] for r in found.values())
        docs = spark.createDataFrame([tuple(r.values()) for r in found.values()], SCHEMA) if name != "encode" else out
        rows = found


def test_other_columns_stay(spark, tmp_path):
    """Extra columns go through all stages but the last, whatever their names."""
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, f"plain words number {i} and {i * i}", "en", "s", 1, 0.5, "mine", [i], "k") for i in range(6)]
    names = ", score double, lang_pred string, ids array<int>, _text string"
    docs = spark.createDataFrame(rows, SCHEMA + names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[5:] == ["score", "lang_pred", "ids", "_text"], name
    assert {(r["score"], r["lang_pred"], r["ids"][0] == r["doc_id"]) for r in docs.collect()} == {(0.5, "mine", True)}


def test_planted_cases(spark, tmp_path):
    draw = random.Random(6)
    plain = lambda: " ".join("".join(draw.choice("aeioulnrst") for _ in range(6)) for _ in range(60))
    copy = plain()
    rows = [(i, plain()) for i in range(20)]
    rows += [(100, copy), (101, copy), (102, copy + " more"), (103, None), (104, "123 456"), (105, f"{plain()} {ITEM}"), (106, plain() + " password=hunter2hunter2")]
    rows += [(100, copy), (None, copy), (None, plain()), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", F.size("ids").alias("n")).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [*range(20), 100, 106]
    assert sum(r["doc_id"] is None for r in out) == 1


def test_near_dedup_of_repeated_and_missing_ids(spark):
    """Rows of one id with different texts are judged apart; rows without id are near copies like others."""
    draw = random.Random(8)
    words = lambda: ["".join(draw.choice("aeioulnrst") for _ in range(6)) for _ in range(60)]
    a, b, c, d = (words() for _ in range(4))
    near = lambda text, i: " ".join([*text[:i], "changed", *text[i + 1 :]])
    whole = " ".join
    rows = [(1, whole(a)), (1, whole(b)), (1, whole(a)), (2, near(b, 1)), (3, near(a, 0))]
    rows += [(None, near(c, 0)), (None, whole(c)), (7, near(c, 59)), (8, near(c, 1))]
    rows += [(None, near(d, 0)), (None, whole(d)), (None, whole(d)), (9, None), (None, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    found = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()), key=repr)
    nameless = [t for i, t in found if i is None and t is not None]
    assert len(nameless) == 1 and nameless[0] in (near(d, 0), whole(d))
    assert [x for x in found if x[0] is not None] == sorted([(1, whole(a)), (1, whole(b)), (7, near(c, 59)), (9, None)], key=repr)
    # Near copies of one id are one document.
    twice = spark.createDataFrame([(4, whole(a), "en", "s", 1), (4, near(a, 0), "en", "s", 1)], SCHEMA)
    assert corpus_pipeline.near_dedup(spark, twice, SF_DIR).count() == 1


def test_texts_go_to_the_workers_once(spark, monkeypatch):
    sent = []
    plain = rank_profiles.map_pieces
    monkeypatch.setattr(rank_profiles, "map_pieces", lambda df, *rest: sent.append(df.columns) or plain(df, *rest))
    docs = spark.createDataFrame([(1, "some plain words", "en", "s", 16), (2, None, "en", "s", 0)], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF_DIR).collect()] == [1]
    assert sent == [docs.columns]
    judged = rank_profiles.identify(docs.withColumn("text", F.encode("text", "utf-8")), rank_profiles.language_profiles(docs), keep=["text", "lang"])
    assert judged.columns == ["text", "lang", "lang_pred", "score"] and [r["lang_pred"] for r in judged.collect()] == ["en", "und"]


def test_stages_take_small_batches(spark):
    rows = corpus_pipeline.BATCH_SETTING
    before = spark.conf.get(rows)
    try:
        for name, stage in corpus_pipeline.STAGES:
            for given, wanted in (("10000", "1000"), ("0", "1000"), ("7", "7")):
                spark.conf.set(rows, given)
                stage(spark, spark.createDataFrame([], SCHEMA), SF_DIR)
                assert spark.conf.get(rows) == wanted, name
    finally:
        spark.conf.set(rows, before)
