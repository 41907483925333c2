"""Connected components by alternating large-star and small-star steps; nothing is collected but two sums a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Links (u, v) to (node, root): root is the smallest node that is reachable. Nodes without a link are left out.

    Each round takes, for every node, the least neighbour (a sum that is combined before the shuffle) and hangs the
    others on it; rounds grow with the logarithm of the longest chain. A join on a hub is split by Spark where it is skewed."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _sums(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = cut(small)
        was, seen = seen, _sums(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
