"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    """A digest that no longer changes once the edges are stars; rows are counted and hashed on the executors."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the least vertex of u's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    up = both.where("v > u").join(least, "u")
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex not above u that u knows, and u, are tied to the least of them."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    near = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node long, component long) for every node that has an edge; component: the least node reachable.

    `edges` has columns a, b (long, not null), in either order; loops and repeats are
    allowed. No edge: no row. The work of a round is two aggregations and two equi-joins.
    The aggregated sides are checkpointed before they are joined, so that both sides of
    a join are plain shuffles, whose skewed partitions (the hubs of large components) AQE
    splits; read straight from its own shuffle an aggregate would leave it no way to.
    Every round is checkpointed, nothing but a digest of the edges reaches the driver. It
    raises if the rounds don't suffice.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = cut(_small_star(_large_star(now)))
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, least, ...) with the least `least` of their components, of edges (a, b) between nodes, as `least`."""
    found = components(edges)
    met = found.join(nodes.select("node", "least"), "node")
    roots = cut(met.groupBy("component").agg(F.min("least").alias("_least")))
    known = cut(found.join(roots, "component").select("node", "_least"))
    return nodes.join(known, "node", "left").withColumn("least", F.coalesce("_least", "least")).drop("_least")
