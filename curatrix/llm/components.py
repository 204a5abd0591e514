"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Nodes above u are the upper ends of its own edges; an edge may come twice, which the small star mends.
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges with u above v. A node's least keeps the node itself, so nothing is joined twice."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _apart(edges: DataFrame) -> bool:
    """Whether edges (u above v) are stars around their least nodes: no node has two above it, or is both."""
    ends = edges.select(F.col("u").alias("node"), "v").union(edges.select("v", F.lit(None)))
    told = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("under"))
    return told.where("low <> high or (low is not null and under > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node of ``edges``; the component is its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each node links to the least
    node it knows until only stars are left. A round is two grouped minima, combined before the
    shuffle, joined back to the edges; a hub's edges are an ordinary skewed join that Spark may split.
    Nothing but a yes or no comes to the driver, and each round's edges are a table in the shared
    folder. Null ends and self links give no edge; a node with self links alone is its own
    component. Repeated edges count once. No edges give no rows.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ends = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now = ends.where("u <> v")
    for _ in range(max_rounds):
        if _apart(now):
            break
        now = materialize(_small_star(_large_star(now)), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    alone = ends.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    told = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).union(alone)
    return told.groupBy("node").agg(F.min("component").alias("component"))
