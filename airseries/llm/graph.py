"""Connected components with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airseries.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph of (u, v) rows; component = least node.

    Alternating large-star and small-star rounds over joins and minima. Each
    round is written to the shared folder, so the plan stays short; the minima
    are pre-aggregated, and as both join sides are plain tables a node with very
    many neighbours is split by the skew join instead of landing in one task.
    Only a row count and a hash sum reach the driver."""
    def minima(pairs: DataFrame) -> DataFrame:
        return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "cc-min")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = written(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "cc-edges")
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(minima(both).select("u", F.least("u", "m").alias("m")), "u")
                 .where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = written(large.where("u <> v").distinct(), "cc-large")
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = minima(low)
        small = (low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v"))
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "cc-edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
