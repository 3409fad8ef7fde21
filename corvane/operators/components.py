"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and an equi-join that adaptive
execution splits where a node has very many edges. No task holds a component, and nothing but a
count of changed rows reaches the driver. Every round is written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b. Large star: link every larger neighbour of a node to the smallest of the
    node and its neighbours. Small star: the same for its smaller neighbours and itself."""
    if large:
        sides = edges.union(edges.select(F.col("b"), F.col("a")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = sides.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        joined = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return joined.filter("a > b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Columns (node, component): the smallest node that each node with an edge can reach.

    Nodes of one edge only with themselves, and null ends, have no row. Repeated edges do not count.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    current = materialise(pairs.filter(F.col("a") > F.col("b")).distinct(), "components")
    digest = None
    for _ in range(max_rounds):
        current = materialise(_star(_star(current, True), False), "components")
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))
        ).first()
        if tuple(state) == digest:
            break
        digest = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
