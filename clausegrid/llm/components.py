"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.storage import stored


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links (a, b)``; the component is its least node.

    Links are turned towards the least neighbour in alternating steps until every node points
    at its component; the number of steps grows with the logarithm of the longest chain.
    Each step is a minimum per node and a join on it, so a node with very many links is
    neither collected nor expanded.
    """
    forward = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stored(forward.distinct(), "links")
    before = None
    while (now := _measure(edges)) != before:
        before = now
        # Every neighbour above a node moves to the node's least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every neighbour below a node, and the node, move to the least of them.
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
