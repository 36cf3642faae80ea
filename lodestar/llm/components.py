"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import checkpointed, forget_shuffles


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root the smallest node it reaches.

    Each step replaces edges by edges to a smaller neighbour, so the table never grows
    beyond its first size; every step is checkpointed, and the loop ends when a pass
    changes no edge, which the count and two sums of full 64-bit hashes of the edges tell. Nodes without an edge to another node do not appear. Null ends,
    loops and repeated edges are ignored; an empty table gives an empty table.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    mark = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == mark:
            forget_shuffles(e.sparkSession)
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        mark = now
