"""Vectors: encoding, pooling, quantisation, exact nearest neighbours.

Nearest neighbours are found block against block: a task holds a block of queries,
multiplies it as a matrix with the stored vectors that come by and gives out only the
k best per query. No pair of rows is ever written or shuffled. Many queries meet only
the stored vectors that can be near, and look only at products beyond their bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import search_terms
from memlake.functions.vectors import quantize_int8
from memlake.operators.ranking import top_k
from memlake.session import durable, settled

DIGITS = 6
# Most queries sent along with the tasks: about 1.6 MB at 384 dimensions.
CARRIED_QUERIES = 4096
# Rows drawn for first bounds, and centres of groups among them.
SAMPLE_VECTORS, CENTRES = 2048, 128
# What one task compares: the queries it holds, the stored vectors it reads.
BLOCK_VECTORS = 131_072
BLOCK_QUERIES = 32_768
# Bytes of held queries, and found rows of them, beyond which a block has fewer.
HELD_BYTES, HELD_ROWS = 64 * 1024 * 1024, 4_000_000
# Blocks are made smaller than this for no number of cores.
LEAST_BLOCK = 1_024
# Rows of a block that are multiplied at a time, to bound the matrix of distances.
TILE = 2_048
# Rows of either side whose products stay in a core's cache.
NEAR_TILE = 1_024
# Pairs gathered before the bounds are drawn in, and pairs multiplied at a time.
FRESH_ROWS, GATHERED = 100_000, 100_000
# Most partitions of one shuffle.
MOST_TASKS = 100_000

HIT_SCHEMA = "query_id long, turn_id long, distance double"

# Fixed value: the usual length of a vector.
DIMENSIONS = 384


# --- building vectors ---------------------------------------------------------


def mean_pool(tokens: DataFrame, by: list[str], vector: str = "vector", mask: str | None = None) -> DataFrame:
    """Mean of the unmasked token vectors per group; zeros where all are masked.

    Sums are combined before the shuffle, so a group of any size sends one vector per task.
    """
    weight = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    values = F.col(vector).cast("array<double>")
    if mask is not None:
        values = F.transform(values, lambda x: x * weight)
    rows = tokens.select(*by, array_to_vector(values).alias("v"), weight.alias("w"))
    sums = rows.groupBy(*by).agg(Summarizer.sum(F.col("v")).alias("s"), F.sum("w").alias("n"))
    n = F.greatest(F.col("n"), F.lit(1.0))
    return sums.select(*by, F.transform(vector_to_array("s"), lambda x: x / n).alias(vector))


def quantized(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("q8", quantize_int8(F.col(vector)))


def embed_texts(
    df: DataFrame,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    text: str = "content",
    dimensions: int = DIMENSIONS,
    prefix: str = "query: ",
    keep_text: bool = False,
) -> DataFrame:
    """Replace ``text`` by ``embedding``, a unit vector of the whole text (with
    ``keep_text`` the text stays, and travels through the Python workers).

    ``load_encoder`` is called once per task and returns a function from a list of
    texts to a matrix; each text gets ``prefix`` first. Without an encoder, a text
    becomes the hashed counts of its search terms.
    """
    if load_encoder is None:
        slots = F.transform(search_terms(F.col(text)), lambda t: term_slot(t, dimensions))
        source, step = df.withColumn("_in", slots), _count_slots(dimensions)
    else:
        source, step = df.withColumn("_in", F.concat(F.lit(prefix), F.col(text))), _encode(load_encoder)
    kept = [c for c in df.columns if keep_text or c != text]
    schema = df.select(*kept, F.array().cast("array<float>").alias("embedding")).schema
    # Filtered by the text: a filter on the input would compute the terms twice.
    return source.where(F.col(text).isNotNull()).select(*kept, "_in").mapInArrow(step, schema)


def term_slot(term: Column, dimensions: int) -> Column:
    """The slot of a term: the first 32 bits of its MD5, which every engine has, modulo the width."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def _with_unit_vectors(batch: pa.RecordBatch, matrix: np.ndarray) -> pa.RecordBatch:
    """The batch with ``embedding`` in place of the input; zero vectors stay zero."""
    rows, width = matrix.shape
    norms = np.linalg.norm(matrix.astype(np.float64), axis=1, keepdims=True)
    matrix = matrix / np.where(norms > 0, norms, 1)
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    vectors = pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))
    names = [n for n in batch.schema.names if n != "_in"]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], vectors], [*names, "embedding"])


def _count_slots(dimensions: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("_in")
            sizes = slots.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(slots)), sizes)
            flat = row * dimensions + slots.flatten().to_numpy(zero_copy_only=False)
            counts = np.bincount(flat.astype(np.int64), minlength=len(slots) * dimensions)
            yield _with_unit_vectors(batch, counts.reshape(len(slots), dimensions))

    return step


def _encode(load_encoder):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder()
        for batch in batches:
            if batch.num_rows:
                yield _with_unit_vectors(batch, np.asarray(encode(batch.column("_in").to_pylist())))

    return step


# --- nearest neighbours -------------------------------------------------------


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    carried_queries: int = CARRIED_QUERIES,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` nearest stored vectors of every query, exact.

    vectors (turn_id, q8), queries (query_id, q8); result (query_id, turn_id,
    distance, rank). Few queries travel to the stored vectors, which then need no
    shuffle; how many there are is checked. Beyond that, blocks of both sides meet.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    stored = vectors.select("turn_id", "q8").where(F.col("q8").isNotNull())
    asked = queries.select("query_id", "q8").where(F.col("q8").isNotNull())
    asked, rows = settled(asked, carried_queries, "query-vectors")
    if rows is not None:
        near = _knn_carried(stored, rows, k, metric)
    else:
        near = _knn_blocks(stored, asked, k, metric, block_vectors, block_queries)
    return top_k(near, ["query_id"], [F.col("distance").asc(), F.col("turn_id").asc()], k)


def _knn_carried(stored: DataFrame, rows: list, k: int, metric: str) -> DataFrame:
    query_ids = np.array([row["query_id"] for row in rows], dtype=np.int64)
    matrix = np.array([row["q8"] for row in rows], dtype=np.int8)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(query_ids, matrix, k, metric)
        for batch in batches:
            best.add(batch.column("turn_id"), batch.column("q8"))
        yield best.result()

    if not rows:
        return stored.sparkSession.createDataFrame([], HIT_SCHEMA)
    return stored.mapInArrow(step, HIT_SCHEMA)


def _knn_blocks(stored: DataFrame, asked: DataFrame, k: int, metric: str, block_vectors: int, block_queries: int) -> DataFrame:
    """Every block of queries meets every part of the stored vectors in one task, which holds the queries.

    The k-th distance of a query to a bounded sample bounds its k-th distance from above, and so does that to the vectors
    a task has read. Vectors come ordered by the nearest of the sample's centres: those around a centre are multiplied with the
    queries whose distance to it, less the vectors' radius, is not beyond the bound (triangle inequality; cosine distances
    are those of unit vectors). Rows are dealt out by their place in the written tables, so no id or vector is hot.
    """
    drawn = stored.orderBy(F.xxhash64("turn_id", "q8"), "turn_id").limit(SAMPLE_VECTORS).toArrow()
    if not drawn.num_rows:
        return stored.sparkSession.createDataFrame([], HIT_SCHEMA)
    sample = _matrix(drawn.column("q8").combine_chunks())
    centres = _points(sample[:CENTRES], metric)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("q8"))
                nearest = _euclidean(_points(vectors, metric), centres).argmin(axis=1)
                columns = [batch.column("turn_id"), _packed(vectors), pa.array(nearest), pa.array(np.arange(seen, seen + batch.num_rows))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "q8", "centre", "slot"])
                seen += batch.num_rows

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                piece = batch.slice(start, TILE)
                vectors = _matrix(piece.column("q8"))
                limit = np.full(piece.num_rows, np.inf)
                if len(sample) >= k:
                    limit = np.partition(_apart(vectors, sample, metric), k - 1, axis=1)[:, k - 1]
                columns = [piece.column("query_id"), _packed(vectors), pa.array(limit), pa.array(np.arange(seen, seen + piece.num_rows))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "q8", "limit", "slot"])
                seen += piece.num_rows

    spark = stored.sparkSession
    placed = durable(stored.select("turn_id", "q8").mapInArrow(place, "id long, q8 binary, centre long, slot long"), "placed-vectors")
    bounded = asked.select("query_id", "q8").mapInArrow(bound, "id long, q8 binary, limit double, slot long")
    n_vectors, n_queries = placed.count(), asked.count()
    held = min(block_queries, max(1, HELD_BYTES // (4 * sample.shape[1] + 8 * len(centres))), max(1, HELD_ROWS // k))
    q_blocks, v_parts = max(1, math.ceil(n_queries / held)), max(1, math.ceil(n_vectors / block_vectors))
    while q_blocks * v_parts < 3 * spark.sparkContext.defaultParallelism and max(n_queries / q_blocks, n_vectors / v_parts) > LEAST_BLOCK:
        if n_queries / q_blocks > n_vectors / v_parts:
            q_blocks += 1
        else:
            v_parts += 1

    own, every = lambda n: F.col("slot") % n, lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = placed.select("*", F.lit(0.0).alias("limit"), F.lit(1).alias("kind"), own(v_parts).alias("v_part"), every(q_blocks).alias("q_block"))
    right = bounded.select("*", F.lit(0).cast("long").alias("centre"), F.lit(0).alias("kind"), own(q_blocks).alias("q_block"), every(v_parts).alias("v_part"))
    task = (F.col("q_block") * v_parts + F.col("v_part")).cast("int").alias("task")
    columns = [task, "kind", "centre", "id", "q8", "limit"]
    dealt = left.select(*columns).unionByName(right.select(*columns))
    # A task's queries come first, then its vectors by centre and id.
    dealt = dealt.repartitionById(min(q_blocks * v_parts, MOST_TASKS), F.col("task")).sortWithinPartitions("task", "kind", "centre", "id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queries, near = None, [], None
        for batch in batches:
            codes = batch.column("task").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                piece, (number, is_vector) = batch.slice(start, stop - start), divmod(int(codes[start]), 2)
                if number != current:
                    if near is not None:
                        yield near.result()
                    current, queries, near = number, [], None
                if not is_vector:
                    queries.append(piece)
                    continue
                if queries:
                    near, queries = _Near(pa.Table.from_batches(queries).combine_chunks().to_batches()[0], centres, k, metric), []
                if near is not None:
                    near.add(piece)
        if near is not None:
            yield near.result()

    return dealt.mapInArrow(step, HIT_SCHEMA)


class _Near:
    """The k nearest vectors of the queries of a block, of which only pairs within the queries' bounds are looked at;
    ties go to the smaller id."""

    def __init__(self, queries: pa.RecordBatch, centres: np.ndarray, k: int, metric: str):
        self.query_ids = queries.column("id").to_numpy(zero_copy_only=False)
        self.vectors = _unpacked(queries.column("q8"))
        self.k, self.metric, self.centres = k, metric, centres
        self.squares = _squares(self.vectors)
        self.away = _euclidean(_points(self.vectors, metric), centres)
        self.rows: dict[type, np.ndarray] = {}
        # Memory of one tile after the other.
        self.products: dict[type, np.ndarray] = {}
        self.near = np.empty(NEAR_TILE**2, bool)
        # Of every query: its bound, and the id of the k-th vector found.
        self.limit = queries.column("limit").to_numpy(zero_copy_only=False).copy()
        self.last = np.full(len(self.query_ids), np.iinfo(np.int64).max)
        # Found so far (place of the query, distance, id), ordered; and what was found since.
        self.found = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.fresh, self.n_fresh = [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        ids, centre = batch.column("id").to_numpy(zero_copy_only=False), batch.column("centre").to_numpy()
        vectors = _unpacked(batch.column("q8"))
        for start in range(0, len(ids), NEAR_TILE):
            part = slice(start, start + NEAR_TILE)
            self._add_tile(ids[part], vectors[part], centre[part])

    def _add_tile(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray) -> None:
        away = np.sqrt(((_points(vectors, self.metric) - self.centres[centre]) ** 2).sum(axis=1))
        starts = np.flatnonzero(np.diff(centre, prepend=-1))
        radii = np.maximum.reduceat(away, starts)
        # Distances are compared after rounding, so a little more than the limit may still tie.
        reach = (self.away[:, centre[starts]] - radii).min(axis=1) <= _widened(self.limit, self.metric)
        reached = np.flatnonzero(reach)
        squares = _squares(vectors)
        kind = self._kind(squares)
        columns = self._columns(vectors, squares, kind)
        least = self._least(ids.min(), vectors.shape[1]).astype(kind)
        rows = self._rows(kind)
        if kind not in self.products:
            self.products[kind] = np.empty(NEAR_TILE**2, kind)
        for start in range(0, len(reached), NEAR_TILE):
            chosen = reached[start : start + NEAR_TILE]
            held = slice(chosen[0], chosen[-1] + 1) if len(chosen) == chosen[-1] - chosen[0] + 1 else chosen
            size, shape = len(chosen) * len(ids), (len(chosen), len(ids))
            products = np.matmul(rows[held], columns, out=self.products[kind][:size].reshape(shape))
            hits = np.flatnonzero(np.greater_equal(products, least[held, None], out=self.near[:size].reshape(shape)))
            if len(hits):
                row, column = np.divmod(hits, len(ids))
                row = chosen[row]
                distances = self._distances(products.ravel()[hits], row, vectors, column, squares)
                self.fresh.append((row, distances, ids[column]))
                self.n_fresh += len(hits)
                if self.n_fresh >= max(FRESH_ROWS, self.k * len(self.query_ids)):
                    self._merge()
                    least = self._least(ids.min(), vectors.shape[1]).astype(kind)

    # For l2 the product is q v - v v / 2, a multiple of 1/2, and the distance q q - 2 product, the square; both are exact.

    def _kind(self, squares: np.ndarray) -> type:
        """Sums of such products below 2**22 are exact in float32."""
        small = np.sqrt(self.squares.max() * squares.max()) + squares.max() / 2 < 2**22
        return np.float32 if self.metric == "cosine" or small else np.float64

    def _rows(self, kind: type) -> np.ndarray:
        if kind not in self.rows:
            points = _points(self.vectors, self.metric).astype(kind)
            self.rows[kind] = np.column_stack([points, np.ones(len(points), kind)]) if self.metric == "l2" else points
        return self.rows[kind]

    def _columns(self, vectors: np.ndarray, squares: np.ndarray, kind: type) -> np.ndarray:
        points = _points(vectors, self.metric).astype(kind)
        return (np.column_stack([points, (-squares / 2).astype(kind)]) if self.metric == "l2" else points).T

    def _least(self, first_id: int, width: int) -> np.ndarray:
        """The least product of a vector that is looked at."""
        if self.metric == "cosine":
            return 1 - self.limit - (1e-5 + width * 2e-7)
        # Equal distance counts only for an id before the last one found.
        return (self.squares - self.limit) / 2 + np.where(self.last <= first_id, 0.5, 0)

    def _distances(self, products: np.ndarray, row: np.ndarray, vectors: np.ndarray, column: np.ndarray, squares: np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            return self.squares[row] - 2 * products.astype(np.float64)
        dots = np.empty(len(row))
        for start in range(0, len(row), GATHERED):
            part = slice(start, start + GATHERED)
            dots[part] = np.einsum("ij,ij->i", self.vectors[row[part]].astype(np.float32), vectors[column[part]].astype(np.float32), dtype=np.float64)
        norms = np.sqrt(self.squares[row] * squares[column])
        return np.round(1 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), DIGITS)

    def _merge(self) -> None:
        row, distance, ids = (np.concatenate(x) for x in zip(self.found, *self.fresh))
        # A square is a whole number, a cosine distance one of millionths.
        whole = np.rint(distance if self.metric == "l2" else distance * 10**DIGITS).astype(np.int64)
        order = np.lexsort((ids, row * 2**32 + whole))
        row, distance, ids = row[order], distance[order], ids[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row)))
        last = rank == self.k - 1
        self.limit[row[last]] = np.minimum(self.limit[row[last]], distance[last])
        self.last[row[last]] = ids[last]
        kept = rank < self.k
        self.found = (row[kept], distance[kept], ids[kept])
        self.fresh, self.n_fresh = [], 0

    def result(self) -> pa.RecordBatch:
        if self.fresh:
            self._merge()
        row, distance, ids = self.found
        if self.metric == "l2":
            distance = np.round(np.sqrt(distance), DIGITS)
        return pa.RecordBatch.from_arrays([pa.array(self.query_ids[row]), pa.array(ids), pa.array(distance)], schema=_hit_fields())


def _packed(vectors: np.ndarray) -> pa.Array:
    """Vectors of bytes as binary values: Spark moves them whole, not element by element."""
    values = vectors.astype(np.int8)
    if not np.array_equal(values, vectors):
        raise ValueError("q8 holds values that are no bytes")
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array) -> np.ndarray:
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(values, np.int8)[bounds[0] : bounds[-1]].reshape(len(column), -1)


def _squares(vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)


def _apart(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all pairs, for l2 their squares; a zero vector is at cosine distance 1 from all."""
    dots = a.astype(np.float64) @ b.astype(np.float64).T
    a_squares, b_squares = _squares(a)[:, None], _squares(b)[None, :]
    if metric == "l2":
        return a_squares + b_squares - 2 * dots
    norms = np.sqrt(a_squares * b_squares)
    return 1 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0) + 1e-6


def _points(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Points whose Euclidean distance orders like the metric."""
    points = vectors.astype(np.float64)
    if metric == "l2":
        return points
    norms = np.linalg.norm(points, axis=1, keepdims=True)
    return points / np.where(norms > 0, norms, 1)


def _widened(limit: np.ndarray, metric: str) -> np.ndarray:
    """The distance of points up to which a vector may be within the limit, with room for rounding."""
    if metric == "l2":
        return np.sqrt(limit) + 1e-5
    return np.sqrt(2 * np.maximum(limit, 0) + 4e-6) + 1e-5


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _hit_fields() -> pa.Schema:
    return pa.schema([("query_id", pa.int64()), ("turn_id", pa.int64()), ("distance", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class _Best:
    """The k nearest vectors seen so far, per query; ties go to the smaller id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
        self.query_ids = query_ids
        self.metric = metric
        self.k = k
        # Sums of int8 products stay below 2**24 up to this width, so float32 is exact.
        self.kind = np.float32 if queries.shape[1] <= 1024 else np.float64
        self.queries = queries.astype(self.kind)
        self.query_squares = np.einsum("ij,ij->i", self.queries, self.queries).astype(np.float64)
        self.turns = np.empty((len(query_ids), 0), dtype=np.int64)
        self.distances = np.empty((len(query_ids), 0), dtype=np.float64)

    def add(self, turn_ids: pa.Array, column: pa.Array) -> None:
        ids, vectors = turn_ids.to_numpy(zero_copy_only=False), _matrix(column)
        for start in range(0, len(ids), TILE):
            self._add_tile(ids[start : start + TILE], vectors[start : start + TILE].astype(self.kind))

    def _add_tile(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        squares = np.einsum("ij,ij->i", vectors, vectors).astype(np.float64)
        turns, distances = [], []
        for start in range(0, len(self.query_ids), TILE):
            part = slice(start, start + TILE)
            dots = (self.queries[part] @ vectors.T).astype(np.float64)
            found = self._distance(dots, self.query_squares[part, None], squares[None, :])
            all_ids = np.concatenate([self.turns[part], np.broadcast_to(ids, dots.shape)], axis=1)
            all_found = np.concatenate([self.distances[part], found], axis=1)
            chosen = self._choose(all_ids, all_found)
            turns.append(np.take_along_axis(all_ids, chosen, axis=1))
            distances.append(np.take_along_axis(all_found, chosen, axis=1))
        self.turns, self.distances = np.concatenate(turns), np.concatenate(distances)

    def _distance(self, dots, query_squares, squares):
        if self.metric == "l2":
            return np.round(np.sqrt(np.maximum(query_squares + squares - 2 * dots, 0)), DIGITS)
        norms = np.sqrt(query_squares * squares)
        return np.round(1 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), DIGITS)

    def _choose(self, ids: np.ndarray, distances: np.ndarray) -> np.ndarray:
        if ids.shape[1] > 4 * self.k:
            # Everything up to the k-th distance stays, so ties are not lost.
            kth = np.partition(distances, self.k - 1, axis=1)[:, self.k - 1]
            width = int((distances <= kth[:, None]).sum(axis=1).max())
            near = np.argpartition(distances, min(width, distances.shape[1]) - 1, axis=1)[:, :width]
        else:
            near = np.broadcast_to(np.arange(ids.shape[1]), ids.shape)
        near_ids, near_distances = np.take_along_axis(ids, near, 1), np.take_along_axis(distances, near, 1)
        order = np.lexsort((near_ids, near_distances), axis=1)[:, : self.k]
        return np.take_along_axis(near, order, axis=1)

    def result(self) -> pa.RecordBatch:
        kept = self.turns.shape[1]
        columns = [np.repeat(self.query_ids, kept), self.turns.ravel(), self.distances.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_hit_fields())


def semantic_score(distance: str = "distance"):
    return F.round(1 - F.col(distance), DIGITS)
