"""Connected components of a graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stash


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up, or only edges from below: the edges are finished components."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the component's smallest node.

    Each round points every node at its smallest neighbour; rounds grow with the logarithm of the graph. Neighbours are
    never gathered: a node with very many is a minimum, summed up before the shuffle, and a join. No edges give no rows.
    """
    cur = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not stars(cur):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        cur = stash(small.distinct(), "edges")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
