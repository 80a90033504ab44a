"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.ranking import top_k

# Fixed value: the constant added to every rank.
RANK_OFFSET = 60
SCORE_DIGITS = 6


def rrf_fuse(lists: list[DataFrame], k: int, offset: int = RANK_OFFSET) -> DataFrame:
    """Sum 1 / (offset + rank) over the lists (query_id, turn_id, rank), best ``k`` per query.

    Every list is already cut to its own top, so the fusion handles at most
    ``len(lists) * k`` rows per query.
    """
    parts = [ranked.select("query_id", "turn_id", (1.0 / (offset + F.col("rank"))).alias("part")) for ranked in lists]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    fused = merged.groupBy("query_id", "turn_id").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    return top_k(fused, ["query_id"], [F.col("score").desc(), F.col("turn_id").asc()], k)
