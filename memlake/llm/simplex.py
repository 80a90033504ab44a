"""Centroid clustering with n-simplex projection.

Some pivots, taken from a bounded sample, form a simplex whose corners have coordinates of their own.
The distances of any row to the pivots make it the apex of a larger simplex over that base: its
apex has one coordinate per pivot, the last one (its height) never negative. For two apexes a and b
of rows x and y the distance between them is a lower bound of d(x, y), and the distance with one of them
mirrored at the base an upper bound:

    lower^2 = sum((a - b)^2)        upper^2 = lower^2 + 4 * height(a) * height(b)

A row's distances to the pivots don't change, so its apex is computed once and written beside it. In each
round a row meets only the centroids whose lower bound is not above its smallest upper bound; these are
compared in exact whole numbers. If one is left, its distance need not be computed at all. The bounds are as
far apart as rows and centroids rise above the base: vectors of few dimensions need few pivots (none is taken that
rises above no base), vectors that fill all their dimensions need nearly as many as these.

How the work is spread: a round reads the written rows once and gives out one row of sums per task and
cluster, so no cluster is gathered anywhere. The centroids (clusters x width whole numbers) are all
that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.mtree import whole_vectors
from memlake.session import durable


@dataclass(frozen=True)
class SimplexParams:
    """``seed`` orders the rows that centroids start from; at most ``pivots`` of the first ``sample_rows`` make the base."""

    clusters: int = 40
    rounds: int = 5
    width: int = 64
    pivots: int = 60
    sample_rows: int = 512
    seed: str = "2"


# Squares of whole numbers up to this size, summed over a row, fit a long integer.
LARGEST = 1 << 27
# A pivot must rise this share of the highest one above the base of those before it.
_LEAST_RISE = 1e-3
# Bounds are computed in floating point; they are widened by this share of the numbers involved.
_SLACK = 1e-6
# Rows compared at a time.
_ROWS_AT_ONCE = 512


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, in floating point."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * (x @ y.T), 0)


@dataclass(frozen=True)
class BaseSimplex:
    """Pivots, and the coordinates of all but the first; the first is the origin."""

    pivots: np.ndarray
    corners: np.ndarray

    @staticmethod
    def of(candidates: np.ndarray, most: int) -> BaseSimplex:
        """Always the candidate that rises highest above those taken, until none does."""
        base = BaseSimplex(candidates[:1], np.zeros((0, 0)))
        highest = 0.0
        while len(base.pivots) < min(most, len(candidates)):
            apexes = base.apexes(candidates)
            next_one = int(apexes[:, -1].argmax())
            rise = apexes[next_one, -1]
            highest = max(highest, rise)
            if rise <= _LEAST_RISE * highest:
                break
            size = len(base.pivots)
            corners = np.zeros((size, size))
            corners[:-1, :-1] = base.corners
            corners[-1] = apexes[next_one]
            base = BaseSimplex(np.vstack([base.pivots, candidates[next_one]]), corners)
        return base

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """One coordinate per pivot, from the rows' distances to the pivots."""
        to_pivots = squares(rows, self.pivots)
        first = to_pivots[:, 0]
        sides = (first[:, None] - to_pivots[:, 1:] + (self.corners**2).sum(axis=1)[None, :]) / 2
        within = np.linalg.solve(self.corners, sides.T).T if len(self.corners) else sides
        height = np.sqrt(np.maximum(first - (within**2).sum(axis=1), 0))
        return np.hstack([within, height[:, None]])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distances between the rows of apexes ``a`` and ``b``."""
    lower = squares(a, b)
    upper = lower + 4 * a[:, -1:] * b[:, -1][None, :]
    slack = _SLACK * ((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] + 1)
    return lower - slack, upper + slack


def nearest(rows: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centre_apexes: np.ndarray, all_distances: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), its exact squared distance, and how many
    exact distances were computed. Without ``all_distances`` rows with one candidate get -1."""
    lower, upper = bounds(apexes, centre_apexes)
    alive = lower <= upper.min(axis=1)[:, None]
    cluster, distance = alive.argmax(axis=1), np.full(len(rows), -1, np.int64)
    computed = 0
    open_rows = np.flatnonzero(all_distances | (alive.sum(axis=1) > 1))
    for start in range(0, len(open_rows), _ROWS_AT_ONCE):
        own = open_rows[start : start + _ROWS_AT_ONCE]
        row, column = np.nonzero(alive[own])
        apart = rows[own[row]].astype(np.int64) - centroids[column]
        exact = np.einsum("ij,ij->i", apart, apart)
        computed += len(exact)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, first)
        # Pairs are in order of row and centroid: the first that reaches the least wins.
        hits = np.flatnonzero(exact == least[row])
        _, winner = np.unique(row[hits], return_index=True)
        cluster[own], distance[own] = column[hits[winner]], least
    return cluster, distance, computed


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _prepared(rows: DataFrame, base: BaseSimplex, width: int) -> DataFrame:
    """Rows with their apexes: what all rounds read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = base.apexes(_matrix(batch.column("v"), width, np.int64))
            size = apexes.shape[1]
            made = pa.ListArray.from_arrays(np.arange(0, apexes.size + 1, size, dtype=np.int32), apexes.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), made], names=["vec_id", "v", "apex"])

    return durable(rows.mapInArrow(run, "vec_id long, v array<int>, apex array<double>"), "apexes")


def _round(prepared: DataFrame, base: BaseSimplex, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums of every non-empty cluster; at most one row per cluster reaches the driver."""
    count, width = centroids.shape
    centre_apexes = base.apexes(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            own = _matrix(batch.column("v"), width, np.int64)
            apexes = _matrix(batch.column("apex"), len(base.pivots), np.float64)
            cluster, _, _ = nearest(own, apexes, centroids, centre_apexes, False)
            # Sums of one batch are whole numbers below 2^53.
            members = np.zeros((count, len(own)))
            members[cluster, np.arange(len(own))] = 1
            sums += (members @ own.astype(np.float64)).astype(np.int64)
            sizes += np.bincount(cluster, minlength=count)
        used = np.flatnonzero(sizes)
        lists = pa.ListArray.from_arrays(np.arange(0, len(used) * width + 1, width, dtype=np.int32), sums[used].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sizes[used]), lists], names=["cluster", "n", "sums"])

    parts = prepared.select("v", "apex").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = [F.sum(F.element_at("sums", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()
    return {row["cluster"]: (row["n"], [int(row[f"s{i}"]) for i in range(width)]) for row in found}


def _assigned(prepared: DataFrame, base: BaseSimplex, centroids: np.ndarray) -> DataFrame:
    centre_apexes = base.apexes(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("v"), centroids.shape[1], np.int64)
            apexes = _matrix(batch.column("apex"), len(base.pivots), np.float64)
            cluster, distance, _ = nearest(own, apexes, centroids, centre_apexes, True)
            columns = [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return prepared.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_rows(rows: DataFrame, params: SimplexParams) -> np.ndarray:
    """The ``sample_rows`` (or ``clusters``) rows with the smallest SHA-256 of ``seed:vec_id``, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.col("vec_id").cast("string")), 256)
    named = rows.where(F.col("vec_id").isNotNull()).select(key.alias("key"), "v")
    drawn = named.orderBy("key", "v").limit(max(params.clusters, params.sample_rows)).toArrow()
    return _matrix(drawn.column("v").combine_chunks(), params.width, np.int64)


def cluster_vectors(rows: DataFrame, params: SimplexParams = SimplexParams()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every row of (vec_id, v).

    ``v`` holds whole numbers; rows of another width, or null, take no part. Centroids 0, 1, ... start as
    the first of ``first_rows``; each round gives every row to its nearest centroid (ties: the smaller
    number) and moves every non-empty one to the floor of its rows' mean; then rows are assigned once more.

    Every row counts, rows with a repeated id too. Rows without id are assigned but start no
    centroid; a table of fewer named rows than ``clusters`` has as many centroids as these. No
    named row: no centroid, no result. Whole numbers beyond 2^27 are refused with ValueError,
    as their squared distances are no long integers. Other columns are ignored.
    """
    spark: SparkSession = rows.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    whole = durable(rows.where(F.size("v") == params.width).select("vec_id", "v"), "whole-vectors")
    span = whole.agg(F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("most")).first()
    if span["most"] is not None and max(span["most"], -span["least"]) > LARGEST:
        raise ValueError(f"components must be whole numbers up to {LARGEST}, found {span['least']} to {span['most']}")
    drawn = first_rows(whole, params)
    if not len(drawn):
        return spark.createDataFrame([], schema)

    base, centroids = BaseSimplex.of(drawn, params.pivots), drawn[: params.clusters]
    prepared = _prepared(whole.withColumn("v", F.col("v").cast("array<int>")), base, params.width)
    for _ in range(params.rounds):
        moved = centroids.copy()
        for cluster, (n, sums) in _round(prepared, base, centroids).items():
            moved[cluster] = [total // n for total in sums]
        centroids = moved

    assigned = durable(_assigned(prepared, base, centroids), "assigned")
    # One row per cluster.
    found = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(row["cluster_inertia"] for row in found)
    names = {i: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for i, c in enumerate(centroids)}
    of_cluster = [(row["cluster"], row["cluster_inertia"], inertia, names[row["cluster"]]) for row in found]
    figures = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select(*[field.split()[0] for field in schema.split(", ")])


def cluster_embeddings(table: DataFrame, params: SimplexParams = SimplexParams()) -> DataFrame:
    """``cluster_vectors`` of (vec_id, embedding), components being floor(256 x)."""
    sized = table.where(F.size("embedding") == params.width)
    return cluster_vectors(whole_vectors(sized, "vec_id", "embedding"), params)
