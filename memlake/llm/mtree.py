"""Exact top-k inner products by best-first search in an M-tree.

A vector takes part as whole numbers. The tree has three levels. Routing objects, fitted on a
bounded sample, have a covering radius and own subtrees; a subtree is a bounded share of
a routing object's rows; its rows lie in pages around a row of their own, with the page's
covering radius and the distances from the page to the routing object and from every row to its page.
Every row is in exactly one page.

The inner product is ranked through the Euclidean metric: q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so a
lower bound of the distance is an upper bound of the score. For a page with centre c, radius r and
parent p, d(q, x) >= d(q, c) - r, and without computing d(q, c), from the stored distance,
d(q, x) >= |d(q, p) - d(p, c)| - r; the same holds for a row within its page. Pages are
visited best bound first until no bound reaches the k-th score found.

How the work is spread: the k-th score of a query against the sample (rows, too) bounds its
result from below, and drops whole routing objects. What is left of the queries is sent, in blocks, to
the subtrees of the remaining objects; subtrees are sized by measured counts, so a vector
copied very often, or a dense region, takes many subtrees. k rows per query and subtree come back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.ranking import top_k
from memlake.session import durable


@dataclass(frozen=True)
class MTreeParams:
    """``sample_rows`` rows, drawn by a hash of their content, give the routing objects and first bounds."""

    k: int = 5
    routing: int = 64
    sample_rows: int = 4096
    subtree_rows: int = 8192
    page_rows: int = 256
    query_block: int = 20_000


# Bounds are computed in floating point; they are widened by this share of the numbers involved.
_SLACK = 1e-9


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x), x as double; vectors with a null or non-finite component are left out."""
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    )
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter vectors filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a b^T of whole numbers: in floating point while every sum is below 2^53, else in long integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    square = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def routing_objects(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: the first, then always the one farthest from those taken."""
    if not len(sample):
        return sample
    taken = [0]
    nearest = distances(sample, sample[:1])[:, 0]
    while len(taken) < min(count, len(sample)):
        far = int(np.argmax(nearest))
        if nearest[far] == 0:
            break
        taken.append(far)
        nearest = np.minimum(nearest, distances(sample, sample[far : far + 1])[:, 0])
    return sample[taken]


def score_bound(query_norm, largest_norm, distance):
    """The largest inner product of a row at least ``distance`` away with a norm of at most ``largest_norm``.

    Both |q||x| and (|q|^2 + |x|^2 - d^2) / 2 are bounds; the second grows with |x|.
    """
    by_distance = (query_norm**2 + largest_norm**2 - np.maximum(distance, 0) ** 2) / 2
    bound = np.minimum(query_norm * largest_norm, by_distance)
    return bound + _SLACK * (query_norm**2 + largest_norm**2 + 1)


@dataclass
class Page:
    ids: np.ndarray
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    to_parent: float
    to_centre: np.ndarray
    norm: float
    norms: np.ndarray


def build_pages(ids: np.ndarray, rows: np.ndarray, parent: np.ndarray, page_rows: int) -> list[Page]:
    """Rows in pages: the row farthest from the parent takes its nearest rows, and so on."""
    left = np.argsort(-distances(rows, parent[None])[:, 0], kind="stable")
    pages = []
    while len(left):
        centre = rows[left[0]]
        away = distances(rows[left], centre[None])[:, 0]
        own = np.argsort(away, kind="stable")[:page_rows]
        taken, to_centre = left[own], away[own]
        size = norms(rows[taken])
        to_parent = float(distances(centre[None], parent[None])[0, 0])
        pages.append(Page(ids[taken], rows[taken], centre, float(to_centre.max()), to_parent, to_centre, float(size.max()), size))
        left = np.delete(left, own)
    return pages


def search_pages(pages: list[Page], parent: np.ndarray, query_id: int, query: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
    """(score, id) of the best k rows but the query's own that reach ``floor``, best first, smaller id first."""
    norm = float(norms(query[None])[0])
    to_parent = float(distances(query[None], parent[None])[0, 0])
    # Bounds from stored distances only; the distance to a page's centre is computed when its turn comes.
    waiting = []
    for number, page in enumerate(pages):
        bound = score_bound(norm, page.norm, abs(to_parent - page.to_parent) - page.radius)
        if bound >= floor:
            waiting.append((-bound, number, -1.0))
    heapq.heapify(waiting)
    best: list[tuple[int, int]] = []
    while waiting:
        bound, number, away = heapq.heappop(waiting)
        least = max(floor, best[0][0]) if len(best) == k else floor
        if -bound < least:
            break
        page = pages[number]
        if away < 0:
            away = float(distances(query[None], page.centre[None])[0, 0])
            bound = min(-bound, score_bound(norm, page.norm, away - page.radius))
            if bound >= least:
                heapq.heappush(waiting, (-bound, number, away))
            continue
        near = score_bound(norm, page.norms, np.abs(away - page.to_centre)) >= least
        for score, own in zip(products(query[None], page.rows[near])[0].tolist(), page.ids[near].tolist()):
            if own != query_id and score >= least:
                entry = (score, -own)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
    return [(score, -own) for score, own in sorted(best, reverse=True)]


def _placed(rows: DataFrame, routing: np.ndarray) -> DataFrame:
    """Rows with their nearest routing object (the first of equally near ones), its distance, and their norm."""
    width = routing.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("v"), width)
            away = distances(own, routing)
            parent = away.argmin(axis=1)
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(parent.astype(np.int32)), pa.array(away.min(axis=1)), pa.array(norms(own))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "parent", "away", "norm"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, parent int, away double, norm double")


def _routed_queries(queries: DataFrame, sample_ids: np.ndarray, sample: np.ndarray, routing: np.ndarray, objects: list[tuple], k: int) -> DataFrame:
    """(query_id, v, floor, parent): the routing objects whose rows may reach a query's floor.

    ``objects`` are (parent, covering radius, largest norm); the floor is the k-th score in the sample.
    """
    parents, radii, largest = (np.array(x) for x in zip(*objects))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                ids, own = piece.column("query_id").to_numpy(), _matrix(piece.column("v"), sample.shape[1])
                scores = products(own, sample)
                floors = np.full(len(ids), np.iinfo(np.int64).min)
                for i, query_id in enumerate(ids):
                    others = scores[i][sample_ids != query_id]
                    if len(others) >= k:
                        floors[i] = np.partition(others, -k)[-k]
                away = distances(own, routing[parents])
                bound = score_bound(norms(own)[:, None], largest[None, :], away - radii[None, :])
                row, column = np.nonzero(bound >= floors[:, None])
                picked = piece.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [picked.column("query_id"), picked.column("v"), pa.array(floors[row]), pa.array(parents[column].astype(np.int32))],
                    names=["query_id", "v", "floor", "parent"],
                )

    return queries.select("query_id", "v").mapInArrow(run, "query_id long, v array<long>, floor long, parent int")


def top_products(rows: DataFrame, queries: DataFrame, params: MTreeParams = MTreeParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product, ties to the smaller vec_id.

    ``rows`` are (vec_id, v), ``queries`` (query_id, v), v whole numbers. A row with the query's
    own id is no candidate. Rows without id are left out; a query id given more than once counts once, with its
    smallest vector. Shorter vectors are filled up with 0. Queries with fewer than k candidates
    get them all; an empty side gives no rows.
    """
    spark = rows.sparkSession
    k = params.k
    rows = durable(rows.where(F.col("vec_id").isNotNull()), "vectors")
    queries = queries.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min("v").alias("v"))
    queries = durable(queries, "queries")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not shape["n"] or not asked["n"]:
        return spark.createDataFrame([], schema)
    width = max(shape["width"], asked["width"])

    drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(params.sample_rows).toArrow()
    sample_ids, sample = drawn.column("vec_id").to_numpy(), _matrix(drawn.column("v"), width)
    routing = routing_objects(sample, min(params.routing, -(-shape["n"] // params.subtree_rows)))
    placed = durable(_placed(rows, routing), "placed-vectors")
    found = placed.groupBy("parent").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect()
    objects = [(r["parent"], r["radius"], r["norm"]) for r in found]
    subtrees = F.create_map(*[F.lit(x) for r in found for x in (r["parent"], -(-r["n"] // params.subtree_rows))])
    blocks = -(-asked["n"] // params.query_block)

    routed = _routed_queries(queries, sample_ids, sample, routing, objects, k)
    routed = routed.select(
        "parent",
        F.explode(F.sequence(F.lit(0), subtrees[F.col("parent")] - 1)).alias("subtree"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        "query_id",
        "v",
        "floor",
    )
    indexed = placed.select(
        "parent",
        F.pmod(F.xxhash64("vec_id", "v"), subtrees[F.col("parent")]).cast("int").alias("subtree"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "vec_id",
        F.col("v").alias("row"),
    )
    sent = spark.sparkContext.broadcast(routing)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            parent = sent.value[key[0].as_py()]
            pages = build_pages(left.column("vec_id").to_numpy(), _matrix(left.column("row"), width), parent, params.page_rows)
            asked_rows = _matrix(right.column("v"), width)
            for i, (query_id, floor) in enumerate(zip(right.column("query_id").to_pylist(), right.column("floor").to_pylist())):
                for score, own in search_pages(pages, parent, query_id, asked_rows[i], k, floor):
                    for column, value in zip(out, (query_id, own, score)):
                        column.append(value)
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(("query_id", "vec_id", "score"), out)})

    keys = ["parent", "subtree", "block"]
    hits = indexed.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = top_k(hits, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
