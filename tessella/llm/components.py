"""Connected components of a graph that only Spark holds: alternating large-star and small-star rounds.

Each round joins edges to the smallest neighbour of each node (found by a partial aggregation, so a hub's
neighbours are never gathered) and is written to the shared folder. It ends when the edges no longer change:
then each node points to the smallest node that it can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): returns node, component for each node with an edge to another node. Repeated edges and loops are fine."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = written(small, "edges")
        was, mark = mark, after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        remove(now)
        now = after
        if was == mark:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
