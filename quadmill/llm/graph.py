"""Connected components over edge tables, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(pairs: DataFrame) -> DataFrame:
    """Each node's smallest neighbour (or itself): pairs must hold both directions where both are to count."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    edges: columns a and b, two longs. Alternates large and small stars (Kiveris et al. 2014) until
    nothing changes; each round is a written table, and hubs are split by AQE, as every step is a
    pre-aggregated minimum joined to its edges.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        own = now.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
        # Stars all: nobody has two smaller neighbours, and no centre hangs on another.
        loose = own.where("v < w").select("u").union(own.select("u").join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi"))
        if loose.isEmpty():
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_star(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        kept = large.distinct()
        small = kept.join(_star(kept), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = scratch.write(small.select("e.u", "e.v").where("u <> v").distinct())
        scratch.drop(now)
        now = after


def nearby(edges: DataFrame) -> DataFrame:
    """(node, component) by two steps down from each node alone: cheaper, and right for stars and chains of two."""
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("down")).groupBy("node").agg(F.min("down").alias("down"))
    next_ = own.select(F.col("node").alias("down"), F.col("down").alias("further"))
    return own.join(next_, "down", "left").select("node", F.coalesce("further", "down").alias("component"))
