"""One query per operator, over whole tables, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import remainder, table
from memlake.llm.ctw import score_texts
from memlake.llm.huffman import stored_ids
from memlake.llm.licenses import scan_licenses
from memlake.llm.minmax import near_duplicates
from memlake.llm.mtree import top_products, whole_vectors
from memlake.llm.piece_fst import encode_texts
from memlake.llm.rank_profiles import identify, language_profiles
from memlake.llm.secrets import scan_secrets
from memlake.llm.simplex import cluster_embeddings
from memlake.llm.survival import audit_filters
from memlake.llm.tiling import contaminated_documents
from memlake.llm.url_filter import judge_urls
from memlake.llm.warc import derivatives, responses

# The pages carry no date of their own.
CAPTURED = "2024-01-01T00:00:00Z"


def op1_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.withColumn("held_out", remainder("doc_id", 10) == 0))


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages"), CAPTURED))


def op4_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mtree_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    queries = rows.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    return top_products(rows, queries)


def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    profiles = language_profiles(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles)


def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_embeddings(table(spark, sf_dir, "embeddings"))


def op12_filter_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return stored_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree_scores": op1_context_tree_scores,
    "op2_string_tiling": op2_string_tiling,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_license_join": op4_license_join,
    "op5_redirect_verdicts": op5_redirect_verdicts,
    "op6_secret_scan": op6_secret_scan,
    "op7_minmax_near_dedup": op7_minmax_near_dedup,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_mtree_top_products": op9_mtree_top_products,
    "op10_rank_order_language": op10_rank_order_language,
    "op11_simplex_clusters": op11_simplex_clusters,
    "op12_filter_survival": op12_filter_survival,
    "op13_huffman_ids": op13_huffman_ids,
}
