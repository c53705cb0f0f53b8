"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component), component the smallest node. Only nodes with an edge appear.

    Each step groups by a node with partial aggregation and joins the minimum back, so a node of very many
    edges is split as any skewed join; the edges shrink to stars in a logarithmic number of rounds.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:  # until a step changes nothing
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        forget(now)
        now = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
