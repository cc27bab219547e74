"""Connected components as joins: alternating large and small stars, cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node reachable) of every node that has an edge to another node and isn't the root itself.

    Edges with a null end are ignored. Minima are pre-aggregated before each shuffle, and the join
    that hands them back is one that adaptive execution may split at a hot node. Each round is
    written to the shared folder; the driver sees a row count and a checksum.
    """
    stars = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars, seen = materialize(stars, "links"), None
    while True:
        state = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, stars = stars, materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
