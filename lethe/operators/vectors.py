"""Vector table algebra. Slots are keyed by (shard_id, id); entities live in one shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT = ["shard_id", "id"]
OWNER = ["shard_id", "entity_id"]


def latest_per_slot(new: DataFrame) -> DataFrame:
    """The last write of each slot by ``seq``, which is unique.

    Only slots and sequence numbers are aggregated. The vectors themselves stay where they are
    unless some slot was written twice, and then meet one row per such slot, so a slot written
    by a third of the batch is no hot spot.
    """
    repeated = (
        new.groupBy(*SLOT)
        .agg(F.max("seq").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(*SLOT, "_last")
    )
    return (
        new.join(repeated, SLOT, "left")
        .where(F.col("_last").isNull() | (F.col("seq") == F.col("_last")))
        .drop("_last")
    )


def upsert_vectors(base: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by slot: an id arriving for another entity of the same shard takes the slot over,
    in another shard both rows stay."""
    latest = latest_per_slot(new)
    kept = base.join(new.select(*SLOT).distinct(), SLOT, "left_anti")
    return kept.select(*base.columns).unionByName(latest.select(*base.columns))


def purge_vectors(base: DataFrame, purged: DataFrame) -> DataFrame:
    """Drop the rows of purged entities from their own shard. ``purged`` has both OWNER columns
    and may repeat entities.

    The stored rows are the streamed side: a small purge list is broadcast by the optimizer's
    own size check, a large one is shuffled and a dominating entity split.
    """
    return base.join(purged.select(*OWNER), OWNER, "left_anti").select(*base.columns)


def present_entities(table: DataFrame) -> DataFrame:
    """Distinct (shard_id, entity_id) of a stored table."""
    return table.select(*OWNER).distinct()


def entity_vectors(vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """Vectors of the given entities, read from their own shards only."""
    return vectors.join(entities.select(*OWNER), OWNER, "left_semi").select(*vectors.columns)


def entity_in_vectors(requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds ``in_vectors``: does the entity own a row in its shard?"""
    found = present_entities(vectors).withColumn("in_vectors", F.lit(True))
    return requests.join(found, OWNER, "left").withColumn(
        "in_vectors", F.coalesce("in_vectors", F.lit(False))
    )


def shard_digests(table: DataFrame, num_shards: int) -> DataFrame:
    """Order-free content digest and row count per shard, empty shards included."""
    columns = sorted(table.columns)
    rows = table.select(
        "shard_id",
        F.xxhash64(*columns).alias("h1"),
        F.xxhash64(F.lit("second"), *columns).alias("h2"),
    )
    # xor alone cannot see a row that occurs twice, the sum and the count can.
    per_shard = rows.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor("h1").alias("digest_xor"),
        F.sum(F.col("h2").cast("decimal(20,0)")).alias("digest_sum"),
    )
    ids = table.sparkSession.range(num_shards).select(F.col("id").cast("int").alias("shard_id"))
    return ids.join(per_shard, "shard_id", "left").fillna(0, ["n_rows"])


def untouched_shards(before: DataFrame, after: DataFrame, purged: DataFrame, num_shards: int):
    """Isolation report: per shard, was it purged from and is its content unchanged?"""
    touched = purged.select("shard_id").distinct().withColumn("touched", F.lit(True))
    b = shard_digests(before, num_shards).alias("b")
    a = shard_digests(after, num_shards).alias("a")
    same = (
        F.col("b.n_rows").eqNullSafe(F.col("a.n_rows"))
        & F.col("b.digest_xor").eqNullSafe(F.col("a.digest_xor"))
        & F.col("b.digest_sum").eqNullSafe(F.col("a.digest_sum"))
    )
    return (
        b.join(a, "shard_id")
        .join(touched, "shard_id", "left")
        .select(
            "shard_id",
            F.col("b.n_rows").alias("n_before"),
            F.col("a.n_rows").alias("n_after"),
            F.coalesce("touched", F.lit(False)).alias("touched"),
            same.alias("unchanged"),
        )
    )
