"""Connected components of a graph too large for one machine: alternating stars.

Every round hangs each node's larger neighbours below its smallest one (large
star), then each node and its smaller neighbours below the smallest of them
(small star). Both are a minimum per node and a join; no neighbour list is ever
gathered. A node with very many edges is one side of a join that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaudit.session import settle


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable from it, for every node with an edge.

    ``edges`` has columns a and b of one orderable type. Loops, repeated edges and
    edges with a null end add nothing. No edges give no rows.
    """
    edges = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = settle(_small_star(settle(_large_star(edges))))
        state, before = _state(edges), state
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """One row that stays the same only if the edges do; equal twice means all stars."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.hash("a", "b").cast("long")),
            F.bit_xor(F.xxhash64("a", "b")),
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    below = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return below.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
