"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; ``u > v`` holds before and after.

    Large: every neighbour above a node moves to the node's smallest neighbour. Small: a
    node's lower neighbours, and itself, move to the smallest of them. Both keep components
    and make paths shorter. Only minima are aggregated, so a hub of any degree is combined
    before it is shuffled, and its rows are split as those of any skewed join.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = (
        edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
        .join(least, "u")
        .select(F.col("w").alias("u"), F.col("m").alias("v"))
        .where("u > v")
        .distinct()
    )
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``a, b``; a component is named by its least node.

    Each round's edges are written to the shared folder. The number of rounds grows with the
    logarithm of the longest path.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = written(pairs.distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()

    before = state(now)
    while before[0]:
        now = written(_stars(now), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
