"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) in both directions: hang larger (or smaller) neighbours on the least one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v < u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter("m < u").select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root: no node has two parents, and no parent has one."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    counts = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not counts.filter("child > 1 or (child > 0 and parent > 0)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); the component is its least node.

    Each step is joins and sums over edges; tables are written between steps, nothing is collected. The
    number of steps grows with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while not settled(edges):
        edges = cut(star(both_ways(cut(star(both_ways(edges), True), "large")), False), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
