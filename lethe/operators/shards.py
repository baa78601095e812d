"""Shard assignment and topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions.hashing import assign_bucket, assign_shard
from lethe.options import EngineOptions


def with_shard(df: DataFrame, num_shards: int) -> DataFrame:
    return df.withColumn("shard_id", assign_shard(F.col("entity_id"), num_shards))


def with_cell(df: DataFrame, options: EngineOptions) -> DataFrame:
    """Adds ``shard_id`` and ``bucket``, the two columns stored tables are laid out by."""
    return with_shard(df, options.num_shards).withColumn(
        "bucket", assign_bucket(F.col("entity_id"), options.buckets)
    )


def slot_rows(located: DataFrame, options: EngineOptions) -> DataFrame:
    """Entries of the slot index for rows with a cell: an id may come again for another entity
    of its shard, so a slot is found by its id and names the cell of its owner."""
    return located.select(
        "id",
        F.col("bucket").alias("owner_bucket"),
        "shard_id",
        assign_bucket(F.col("id"), options.buckets).alias("bucket"),
    )


def shard_hubs(spark, num_shards: int) -> DataFrame:
    """The hub node of every shard, empty ones included."""
    return spark.range(max(num_shards, 1)).select(
        F.col("id").cast("int").alias("shard_id"),
        F.concat(F.lit("shard_"), F.col("id").cast("string")).alias("node_id"),
    )


def shard_topology(documents: DataFrame, num_shards: int) -> DataFrame:
    """Documents and distinct entities per shard hub.

    Two aggregation levels: entities first, so a shard is summed from partial counts and the
    distinct count needs no per-shard set of entities.
    """
    per_entity = (
        documents.groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("docs"))
        .withColumn("shard_id", assign_shard(F.col("entity_id"), num_shards))
    )
    counts = per_entity.groupBy("shard_id").agg(
        F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("entities")
    )
    return (
        shard_hubs(documents.sparkSession, num_shards)
        .join(counts, "shard_id", "left")
        .select(
            "shard_id",
            "node_id",
            F.coalesce("docs", F.lit(0)).alias("docs"),
            F.coalesce("entities", F.lit(0)).alias("entities"),
        )
    )


def topology_links(documents: DataFrame, num_shards: int) -> DataFrame:
    """One link per document node from its shard hub."""
    return with_shard(documents, num_shards).select(
        F.concat(F.lit("shard_"), F.col("shard_id").cast("string")).alias("source"),
        F.concat_ws("_", F.lit("entity"), "entity_id", "id").alias("target"),
    )
