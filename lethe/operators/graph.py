"""Entity-scoped property graph as tables. Every table carries the entity's shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.operators.vectors import OWNER, present_entities, purge_vectors


def concept_key(entity_id: Column, name: Column) -> Column:
    """``entity:name``; an identifier cannot hold a colon, so keys do not collide."""
    return F.concat(entity_id, F.lit(":"), name)


def concepts_of(triplets: DataFrame) -> DataFrame:
    """Subject and object nodes of triplet rows, one scan, one row per node."""
    names = triplets.select(
        *OWNER, F.explode(F.array_distinct(F.array("subject", "object"))).alias("name")
    ).distinct()
    return names.select(
        concept_key(F.col("entity_id"), F.col("name")).alias("concept_id"),
        "name",
        "entity_id",
        "shard_id",
    )


def new_concepts(base: DataFrame, triplets: DataFrame) -> DataFrame:
    """Nodes of the triplets that are not stored yet.

    The stored side is first reduced to the batch's own nodes: it is streamed past their keys,
    if these are few enough to be broadcast, and only the rows that match are shuffled.
    """
    keys = ["shard_id", "concept_id"]
    found = concepts_of(triplets)
    known = base.select(*keys).join(found.select(*keys), keys, "left_semi")
    return found.join(known, keys, "left_anti")


def upsert_concepts(base: DataFrame, triplets: DataFrame) -> DataFrame:
    return base.unionByName(new_concepts(base, triplets))


def knowledge_rows(triplets: DataFrame, timestamp: Column) -> DataFrame:
    """One edge per triplet occurrence; repeats are kept."""
    return triplets.select(
        concept_key(F.col("entity_id"), F.col("subject")).alias("sub_id"),
        concept_key(F.col("entity_id"), F.col("object")).alias("obj_id"),
        "predicate",
        "shard_id",
        "entity_id",
        timestamp.alias("timestamp"),
    )


def append_knowledge(base: DataFrame, triplets: DataFrame, timestamp: Column) -> DataFrame:
    return base.unionByName(knowledge_rows(triplets, timestamp))


def clear_purge_marks(marks: DataFrame, triplets: DataFrame) -> DataFrame:
    """New knowledge about an entity lifts its purge marks; an ingest without triplets does not."""
    # The build side of this join is never split, so an entity stands in it once.
    taught = triplets.select("entity_id").distinct()
    kept = marks.join(taught, "entity_id", "left_anti")
    return kept.select(*marks.columns)


def purge_subgraph(
    knowledge: DataFrame, concept: DataFrame, purged: DataFrame
) -> tuple[DataFrame, DataFrame]:
    return purge_vectors(knowledge, purged), purge_vectors(concept, purged)


def upsert_nodes(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Node upsert: the newest ``updated_at`` per key replaces the stored row."""
    latest = new.groupBy(*keys).agg(F.max("updated_at").alias("updated_at"))
    kept = base.join(latest.select(*keys), keys, "left_anti")
    return kept.select(*base.columns).unionByName(latest.select(*base.columns))


def record_purge(
    entity: DataFrame, shard: DataFrame, marks: DataFrame, purges: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity and shard nodes plus one appended purge relation per row of ``purges``
    (entity_id, shard_id, timestamp)."""
    stamped = purges.withColumn("updated_at", F.col("timestamp"))
    return (
        upsert_nodes(entity, stamped, ["entity_id", "shard_id"]),
        upsert_nodes(shard, stamped, ["shard_id"]),
        marks.unionByName(purges.select(*marks.columns)),
    )


def affected_shards(entity: DataFrame, marks: DataFrame, shard: DataFrame) -> DataFrame:
    """Entity to shard over the purge relation, one row per relation, repeats kept.

    The shard table has one row per shard, an option of the job, so broadcasting it is bounded.
    """
    return (
        marks.select("entity_id", "shard_id")
        .join(entity.select("entity_id"), "entity_id", "left_semi")
        .join(F.broadcast(shard.select("shard_id")), "shard_id", "left_semi")
        .select("entity_id", "shard_id")
    )


def entity_in_graph(requests: DataFrame, concept: DataFrame) -> DataFrame:
    """Adds ``in_graph``: does the entity own a concept?"""
    found = present_entities(concept).withColumn("in_graph", F.lit(True))
    return requests.join(found, OWNER, "left").withColumn(
        "in_graph", F.coalesce("in_graph", F.lit(False))
    )


def concept_isolation(before: DataFrame, after: DataFrame, purged: DataFrame) -> DataFrame:
    """Per entity: concepts before and after a purge, and whether that is as it must be."""

    def counts(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("entity_id").agg(F.count(F.lit(1)).alias(name))

    gone = purged.select("entity_id").distinct().withColumn("purged", F.lit(True))
    return (
        counts(before, "n_before")
        .join(counts(after, "n_after"), "entity_id", "full")
        .join(gone, "entity_id", "left")
        .select(
            "entity_id",
            F.coalesce("n_before", F.lit(0)).alias("n_before"),
            F.coalesce("n_after", F.lit(0)).alias("n_after"),
            F.coalesce("purged", F.lit(False)).alias("purged"),
        )
        .withColumn(
            "isolated",
            F.when(F.col("purged"), F.col("n_after") == 0).otherwise(
                F.col("n_after") == F.col("n_before")
            ),
        )
    )
