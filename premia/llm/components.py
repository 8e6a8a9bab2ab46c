"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.shared import materialize


def _towards_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least neighbour of u, or u itself, as m.

    The minimum is aggregated before the shuffle; the join, whose sides are both dealt out anew, can split a hot u.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(materialize(least, "least"), "u").select("u", "v", F.least("u", "least").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """pairs: (a, b), of any order, repeated or not. One row per node: node, component (its smallest node).

    Every round writes its edges to the shared folder, which cuts the lineage. It ends when a round changes
    nothing, after about the logarithm of the longest chain; more than `rounds` raise an error.
    """
    ordered = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = materialize(ordered, "edges")
    mark = _mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _towards_least(materialize(large, "large"))
        small = down.select("u", F.col("m").alias("v")).unionByName(down.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        edges = materialize(small, "edges")
        now = _mark(edges)
        if now == mark:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component")).distinct()
        mark = now
    raise RuntimeError(f"components not settled after {rounds} rounds")
