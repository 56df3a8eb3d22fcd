"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _settled(edges: DataFrame) -> bool:
    """Whether every node is a root or has one edge, which leads to a root: a further round would change nothing."""
    up, down = F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(
        F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = edges.select(F.explode(F.array(up, down)).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.where("up > 1 OR up > 0 AND down > 0").agg(F.count("*").alias("n")).first()["n"] == 0


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the component's smallest node.

    A round is two aggregations with joins of which only the edge tables grow
    with the data; the number of rounds grows with the logarithm of the longest path.
    The driver holds every round's plan for a while, so a round names each table as seldom as it can.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        pair = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.select(F.explode(F.array(*pair)).alias("e")).select("e.*")
        low = both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.join(low, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # the edge to the least neighbour itself comes out as (m, m) first
        pair = F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
        small = large.join(least, "u").select(F.explode(F.array(*pair)).alias("e")).select("e.*")
        edges = written(small.where("u != v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
