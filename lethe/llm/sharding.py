"""Sharding by rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import place_of, row_number_in_task, task_of, written

# Rows numbered together, the largest group one task sorts.
BLOCK = 1 << 18


def _draw(key: Column, shard: int) -> Column:
    """Uniform in (0, 1), fixed by key and shard: the upper 53 bits of a 64-bit hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def rendezvous_shard(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard whose weighted draw for this key is best.

    The best is the smallest ``-ln(draw) / weight``, so a shard gets its share of the weights.
    A draw depends on key and shard alone: adding a shard moves to it the keys it wins and no
    others, removing one moves only its own keys, and a changed weight moves keys only from or
    to that shard. Equal draws go to the larger shard id. Shards of weight 0 get nothing. A
    null key hashes like any other value.
    """
    live = {s: w for s, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no shard has a positive weight")
    draws = [
        F.struct((F.log(_draw(key, s)) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard"))
        for s, w in sorted(live.items())
    ]
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    return best["shard"]


def assign_shards(
    df: DataFrame,
    key: str,
    weights: Mapping[int, float],
    shard: str = "shard",
    grown: Mapping[int, float] | None = None,
    grown_shard: str = "grown_shard",
) -> DataFrame:
    """Add the shard of every row, and the one it would have under other weights.

    A narrow projection: no shuffle, any number of rows, repeated keys go together. Columns
    that have the names of the added ones are replaced; others pass through.
    """
    out = df.withColumn(shard, rendezvous_shard(F.col(key), weights))
    if grown is not None:
        out = out.withColumn(grown_shard, rendezvous_shard(F.col(key), grown))
    return out


def number_slots(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without a gap.

    Rows are written once with the task and place they had there; slots follow that order.
    Blocks of at most ``BLOCK`` neighbouring rows are counted per shard, the running sum of
    the few counts gives each block its first slot, and a window numbers within the block. So
    no task ever holds a shard, whatever its size, and a key that fills a third of the table
    is spread over its blocks. An empty table gives an empty result.
    """
    row = "slot_row"
    base = written(df.withColumn(row, row_number_in_task()), "slots")
    task, block = task_of(F.col(row)), F.floor(place_of(F.col(row)) / BLOCK)
    placed = base.withColumn("slot_task", task).withColumn("slot_block", block)
    counts = placed.groupBy(shard, "slot_task", "slot_block").agg(F.count("*").alias("n"))
    # One row per shard and block of BLOCK rows: a running sum per shard stays small.
    before = F.sum("n").over(
        Window.partitionBy(shard).orderBy("slot_task", "slot_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        shard, "slot_task", "slot_block", F.coalesce(before, F.lit(0)).alias("slot_first")
    )
    within = F.row_number().over(Window.partitionBy(shard, "slot_task", "slot_block").orderBy(row)) - 1
    return (
        placed.withColumn("slot_within", within)
        .join(starts, [shard, "slot_task", "slot_block"])
        .withColumn(slot, F.col("slot_first") + F.col("slot_within"))
        .drop(row, "slot_task", "slot_block", "slot_first", "slot_within")
    )

