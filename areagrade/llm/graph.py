"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of (u, v) edges but the roots: root is the least node of its component.

    Alternates the large-star and small-star steps until the edges are stars. Nodes of any
    ordered type; rows with a null end count for nothing. Each round is a checkpoint, so that
    lineage does not grow and lost executors do not matter.
    """
    edges = edges.select("u", "v").where("u <> v").checkpoint()
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        roots = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(roots, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = state
