"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), where the root is the smallest node reachable.

    Alternates large-star and small-star steps, which end in about the logarithm of the longest path.
    Each step aggregates neighbours to one minimum per node before it joins, so a hub is no group, and
    writes its edges, so lineage stays short.  Only a count and a checksum reach the driver.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = scratch.save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(star, "edges")
        scratch.drop(now, least, large, low)
        now, got = after, mark(after)
        if got == seen:
            break
        seen = got
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
