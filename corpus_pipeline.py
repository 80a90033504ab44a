"""The corpus pipeline: documents in, encoded training texts out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of documents, the last one the encoded texts. Each stage keeps every document
that its operator finds nothing against.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import free_name, remainder, table
from memlake.llm.minmax import MinMaxParams, near_groups, row_key
from memlake.llm.piece_fst import encode_texts
from memlake.llm.rank_profiles import UNDECIDED, identify, language_profiles
from memlake.llm.secrets import redact_secrets
from memlake.llm.tiling import clean_documents, text_key
from memlake.session import durable

# A text nearer to no language than this is none: its n-grams are out of place almost everywhere.
LEAST_LANGUAGE_SCORE = 0.2

# Spark and the Python worker both hold a whole Arrow batch: whole texts go in batches of fewer rows than Spark's 10,000.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The stage, in a session with Arrow batches of ``BATCH_ROWS`` rows at most. The setting stays: results are computed later."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay; null texts, those without letters and those far from all languages go."""
    profiles = language_profiles(docs.where(remainder("doc_id", 4) != 2))
    # Columns of documents named like the operator's results step aside.
    aside = {c: free_name(docs, f"_own_{c}") for c in ("lang_pred", "score") if c in docs.columns}
    moved = docs.withColumnsRenamed(aside)
    judged = identify(moved, profiles, keep=moved.columns)
    decided = (F.col("lang_pred") != UNDECIDED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(decided).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays (five-word shingles, similarity 0.8).

    Rows are known by id and text: of one id with different texts each is judged on its own, and only rows
    equal in both are one document. A row without id stays where its group has none with one.
    """
    groups = near_groups(docs, MinMaxParams(width=5))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = groups.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(order)["key"].alias("key"))
    alone = groups.where(F.col("component").isNull()).select("key")
    key, same = free_name(docs, "_key"), free_name(docs, "_same")
    stays = first.select("key").unionByName(alone).distinct().withColumnRenamed("key", key)
    kept = docs.withColumn(key, row_key()).join(stays, key, "left_semi")
    return kept.withColumn(same, text_key()).dropDuplicates(["doc_id", same]).select(*docs.columns)


@small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with secrets replaced and n_chars counted anew."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_ids, round_trip."""
    return encode_texts(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("remove_secrets", remove_secrets),
    ("encode", encode),
]

# Tiling and piece paths can't be written in SQL; tests/llm has the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
