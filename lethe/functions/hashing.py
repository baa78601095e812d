"""Shard, bucket and certificate hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_slice(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def assign_shard(entity_id: Column, num_shards: int) -> Column:
    """Deterministic shard in ``[0, num_shards)``; zero shards act as one."""
    shards = max(int(num_shards), 1)
    return (_hex_slice(F.sha2(entity_id, 256), 1, 8) % shards).cast("int")


def assign_bucket(entity_id: Column, buckets: int) -> Column:
    """Physical cell inside a shard, from digest bits :func:`assign_shard` does not use."""
    return (_hex_slice(F.sha2(entity_id, 256), 9, 8) % max(int(buckets), 1)).cast("int")


def certificate_hash(entity_id: Column, shard_id: Column, epoch: Column) -> Column:
    """Lower-hex SHA-256 of ``entity:shard:epoch``."""
    payload = F.concat(
        entity_id, F.lit(":"), shard_id.cast("string"), F.lit(":"), epoch.cast("string")
    )
    return F.sha2(payload, 256)


def audit_id(shard_id: Column, epoch: Column, digest: Column, seq: Column) -> Column:
    return F.concat_ws(
        "_",
        F.lit("audit"),
        shard_id.cast("string"),
        epoch.cast("string"),
        F.substring(digest, 1, 8),
        seq.cast("string"),
    )
