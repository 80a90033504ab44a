"""One entry for keyword, semantic and hybrid search."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.times import days_before
from memlake.operators.filters import hit_context, lookup_turns, time_condition
from memlake.operators.hybrid import rrf_fuse
from memlake.operators.keyword import KeywordIndex, keyword_search
from memlake.operators.vector import embed_texts, knn, quantized, semantic_score
from memlake.session import durable, settled, shuffle_width

# The default number of hits and the default mode.
TOP_K = 5
MODE = "hybrid"

# Queries up to this number are put into the plan as literal rows.
LITERAL_QUERIES = 1_000
# Hits are sent to all tasks only up to this many rows.
BROADCAST_HITS = 100_000
# Turns are looked up by their ids only up to this many hits.
LOOKUP_HITS = 100


@dataclass(frozen=True)
class SearchFilter:
    """Both time bounds are inclusive; ``last_days`` (with ``now_ms``) overrides ``after_ms``.

    ``profile`` keeps a search to one profile. Keyword statistics are then that profile's: the
    index must have been read for it.
    """

    after_ms: int | None = None
    before_ms: int | None = None
    last_days: int | None = None
    now_ms: int | None = None
    role: str | None = None
    profile: str | None = None

    def after(self) -> int | None:
        if self.last_days is None:
            return self.after_ms
        if self.now_ms is None:
            raise ValueError("last_days needs now_ms")
        return days_before(self.now_ms, self.last_days)

    def time(self) -> Column | None:
        """Time and profile: what is filtered before the cut in either order."""
        own = None if self.profile is None else F.col("profile_id") == self.profile
        return _both(time_condition(self.after(), self.before_ms), own)

    def condition(self) -> Column | None:
        return _both(self.time(), None if self.role is None else F.col("role") == self.role)

    def columns(self) -> list[str]:
        """Columns of a turn that the filters read."""
        return ["timestamp_ms", "role", *(["profile_id"] if self.profile is not None else [])]


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def search(
    turns: DataFrame,
    queries: DataFrame,
    index: KeywordIndex | None = None,
    vectors: DataFrame | None = None,
    mode: str = MODE,
    k: int = TOP_K,
    filters: SearchFilter = SearchFilter(),
    filter_order: str = "pre",
    metric: str = "l2",
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    text: str = "preview",
    degrade: bool = False,
    at_once: bool = False,
) -> DataFrame:
    """Search hits with their context: query_id, rank, turn_id, score, preview,
    session_id, timestamp_ms, role.

    queries: query_id, text, and optionally q8 where the queries are vectors already.
    ``filter_order="pre"`` filters before the cut to k. ``"post"`` filters after it
    (keyword search: time before, role after), and may return fewer hits.
    ``degrade`` computes the two sides of a hybrid search at once and goes on with one if the
    other fails (an encoder that can't be loaded, say); the failure is logged.
    ``at_once`` computes the hits on call; the turns of up to 100 are then looked up by id, of all others nothing is read.
    """
    if filter_order not in ("pre", "post"):
        raise ValueError(f"unknown filter order: {filter_order}")
    if index is not None and index.profile != filters.profile:
        raise ValueError("read the index for the profile that is searched")
    queries, rows = settled(queries, LITERAL_QUERIES, "queries")
    if mode == "keyword":
        ranked = keyword_hits(turns, index, queries, k, filters, filter_order)
    elif mode == "semantic":
        ranked = semantic_hits(turns, vectors, queries, k, filters, filter_order, metric, load_encoder)
    elif mode == "hybrid":
        sides = []
        if vectors is not None:
            sides.append(lambda: semantic_hits(turns, vectors, queries, k, filters, filter_order, metric, load_encoder))
        if index is not None:
            sides.append(lambda: keyword_hits(turns, index, queries, k, filters, filter_order))
        if not sides:
            raise ValueError("hybrid search needs an index or vectors")
        ranked = rrf_fuse(_working(sides) if degrade else [side() for side in sides], k)
    else:
        raise ValueError(f"unknown mode: {mode}")
    if at_once:
        ranked, hits = settled(ranked, LOOKUP_HITS, "hits")
        if hits is not None:
            return with_context(ranked, lookup_turns(turns, sorted({hit["turn_id"] for hit in hits})), True, text)
    few = rows is not None and len(rows) * k <= BROADCAST_HITS
    return with_context(ranked, turns, few, text)


def _working(sides: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """The hits of the sides that can be computed; the last failure is raised if none can."""
    lists, failure = [], None
    for side in sides:
        try:
            lists.append(durable(side(), "hits"))
        except Exception as error:  # whatever an encoder or an index raises
            logging.getLogger(__name__).warning("one side of a hybrid search failed: %s", error)
            failure = error
    if not lists:
        raise failure
    return lists


def with_context(ranked: DataFrame, turns: DataFrame, few_hits: bool, text: str = "preview") -> DataFrame:
    """Join hits with their turns. A number of hits that is known to be small travels
    to the turns; otherwise both sides meet by turn_id."""
    context = hit_context(F.broadcast(ranked) if few_hits else ranked, turns, text)
    return context.select("query_id", "rank", "turn_id", "score", "preview", "session_id", "timestamp_ms", "role")


def keyword_hits(
    turns: DataFrame, index: KeywordIndex | None, queries: DataFrame, k: int, filters: SearchFilter, filter_order: str
) -> DataFrame:
    if index is None:
        raise ValueError("keyword search needs an index")
    if filter_order == "pre":
        return keyword_search(_carrying(index, turns, filters, filters.condition()), queries, k, condition=filters.condition())
    hits = keyword_search(_carrying(index, turns, filters, filters.time()), queries, k, condition=filters.time())
    return hits if filters.role is None else _ranked_again(_matching(hits, turns, filters, F.col("role") == filters.role))


def semantic_hits(
    turns: DataFrame,
    vectors: DataFrame | None,
    queries: DataFrame,
    k: int,
    filters: SearchFilter,
    filter_order: str,
    metric: str = "l2",
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
) -> DataFrame:
    if vectors is None:
        raise ValueError("semantic search needs vectors")
    if "q8" not in queries.columns:
        queries = quantized(embed_texts(queries.select("query_id", "text"), load_encoder, "text"))
    condition = filters.condition()
    if condition is not None and filter_order == "pre":
        vectors = _dealt(_matching(vectors, turns, filters, condition), vectors, filters)
    elif filters.profile is not None:
        # Another profile's turns never take a place.
        vectors = _dealt(_matching(vectors, turns, filters, F.col("profile_id") == filters.profile), vectors, filters)
    near = knn(vectors, queries, k, metric)
    if condition is not None and filter_order == "post":
        near = _ranked_again(_matching(near, turns, filters, condition))
    return near.select("query_id", "turn_id", semantic_score().alias("score"), "rank")


def _dealt(kept: DataFrame, vectors: DataFrame, filters: SearchFilter) -> DataFrame:
    """Vectors that were joined with their turns, dealt out to as many tasks as the session shuffles to. Their bytes are
    few for the work that they make: put together by size, they would be compared by one task."""
    joined = not set(filters.columns()) <= set(vectors.columns)
    return kept.repartition(shuffle_width(kept.sparkSession)) if joined else kept


def _matching(rows: DataFrame, turns: DataFrame, filters: SearchFilter, condition: Column) -> DataFrame:
    """Rows whose turn meets the condition; no join where the rows carry the columns."""
    if set(filters.columns()) <= set(rows.columns):
        return rows.where(condition)
    return rows.join(turns.where(condition).select("turn_id"), "turn_id", "left_semi")


def _ranked_again(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(order))


def _carrying(index: KeywordIndex, turns: DataFrame, filters: SearchFilter, condition: Column | None) -> KeywordIndex:
    """Postings with the filters' columns, joined in where the index does not carry them."""
    missing = [c for c in filters.columns() if c not in index.postings.columns]
    if condition is None or not missing:
        return index
    return replace(index, postings=index.postings.join(turns.select("turn_id", *missing), "turn_id"))
