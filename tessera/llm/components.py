"""Connected components by alternating large-star and small-star steps.

Edges and labels stay distributed.  A large-star step links each node's larger
neighbours to its smallest neighbour, a small-star step its smaller ones; both
leave components as they are and end in stars around the smallest node.  All
neighbours of a node need never meet: the minimum is an aggregate with map-side
combining, and the join back to the edges is one of two shuffled sides, of which
Spark splits the partition that the star around a giant component's root makes
(adaptive skew join); the side that is repeated for it has one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

def with_minimum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows and the least of value and key over the rows of its key."""
    least = rows.groupBy(key).agg(F.least(F.min(value), F.first(key)).alias(name))
    return rows.join(least, key)


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = with_minimum(both, "u", "v", "m")
    return near.where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where("u < v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    near = with_minimum(down, "u", "v", "m")
    kept = near.where("v <> m").select(F.col("m").alias("u"), "v")
    return kept.union(near.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u < v").distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether edges u < v are stars around their smallest nodes, which no further step
    changes: no v has two u or is one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("inner")).union(edges.select("v", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("inner").alias("inner")).where("n > 1 OR n = 1 AND inner = 1").isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of edges (u, v): component is the least
    node reachable.  Nodes without edges to others are not returned."""
    now = common.materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), label)
    while True:
        if are_stars(now):
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u"), F.col("u")).distinct())
        stepped = common.materialize(small_star(large_star(now)), label)
        common.release(now.sparkSession, now)
        now = stepped
