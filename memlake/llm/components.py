"""Connected components by alternating stars, as joins and aggregates only.

Every round links each node's larger neighbours to its smallest one, then its smaller
neighbours; the number of edges never grows and rounds grow with the logarithm of the
longest path. A node with very many neighbours is never gathered: its smallest neighbour is
an aggregate combined before the shuffle, and the join that hands it out reads written
tables on both sides, so that Spark can split the hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    Edges with a null end and loops are left out; repeated edges count once; an empty
    input gives no rows.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = durable(known.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")), "edges")
    while True:
        both = _both_ways(pairs)
        smallest = durable(both.groupBy("u").agg(F.min("w").alias("least"), F.max("w").alias("most")), "large-star")
        # All is done when every node with a smaller neighbour has no other one: stars around the smallest nodes are left.
        if smallest.where((F.col("least") < F.col("u")) & (F.col("least") != F.col("most"))).isEmpty():
            return smallest.select(F.col("u").alias("node"), F.least("u", "least").alias("component"))
        pairs = _small_star(_large_star(both, smallest))


def _both_ways(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("v").alias("u"), F.col("m").alias("w"))
    return both.unionByName(pairs.select(F.col("m").alias("u"), F.col("v").alias("w")))


def _large_star(both: DataFrame, smallest: DataFrame) -> DataFrame:
    """One edge for each of the input; repeated ones fall away in the small star."""
    larger = both.where(F.col("w") > F.col("u")).join(smallest.select("u", F.least("u", "least").alias("least")), "u")
    return durable(larger.select(F.col("w").alias("v"), F.col("least").alias("m")), "edges")


def _small_star(pairs: DataFrame) -> DataFrame:
    smallest = durable(pairs.groupBy("v").agg(F.min("m").alias("least")), "small-star")
    moved = pairs.join(smallest, "v").where(F.col("m") != F.col("least"))
    moved = moved.select(F.col("m").alias("v"), F.col("least").alias("m"))
    return durable(moved.unionByName(smallest.select("v", F.col("least").alias("m"))).distinct(), "edges")
