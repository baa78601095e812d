"""Move a store to another shard or bucket count."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe import schemas
from lethe.functions.hashing import assign_bucket
from lethe.operators.shards import with_cell
from lethe.sources.store import ShardedStore

# Entity data follows the entity to its new shard.
MOVED = ("vectors", "concept", "knowledge")


def reshard(source: ShardedStore, target: ShardedStore) -> None:
    """Copy every table into an empty store with other options, in one commit.

    Purge marks, certificates and outcomes name the shard the purge happened on, and the
    certificate hash covers it, so they keep that number; entity nodes are keyed by entity.
    """
    if target.manifest["tables"]:
        raise ValueError("the target store is not empty")
    change = target.begin()
    for table in schemas.STORED:
        if table == "slots":
            continue  # made anew with the vectors
        rows = source.read(table).drop("bucket")
        if table in (*MOVED, "entity"):
            rows = with_cell(rows, target.options)
        elif table == "shard":
            rows = rows.withColumn("bucket", F.lit(0))
        else:
            rows = rows.withColumn(
                "bucket", assign_bucket(F.col("entity_id"), target.options.buckets)
            )
        change.append(table, rows)
    change.commit(applied=source.manifest["applied"])
