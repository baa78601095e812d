"""State after a mixed log of ingest and unlearn requests, computed set-wise.

Sequential handlers would apply the log row by row. Two facts per ingest replace that: the
next ingest of its slot (shard, id), which overwrites its row, and the next unlearn attempt on
its entity, which erases it. Both are "next row with the same key" lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe import messages
from lethe.operators.ranks import with_running_sum
from lethe.operators.vectors import OWNER, SLOT

SPAN = 1 << 18  # rows of the log per span


def ranked(log: DataFrame) -> DataFrame:
    """Adds ``_rank``, the place in the order of ``seq``. Only the numbers are ordered and
    written; they may be as sparse as they like."""
    places = with_running_sum(log.select("seq"), ["seq"], before="_rank")
    return log.join(places, "seq")


def next_seq(df: DataFrame, keys: list[str], wanted: str, out: str, span: int = SPAN):
    """Adds ``out``: the smallest ``seq`` above the row's own, same keys, where ``wanted``.

    A window per key would put a key with a third of the log into one task. The log is cut
    into spans of so many rows by the rank of ``seq`` (:func:`ranked`): the window runs per key
    and span, and a second one over one row per key and non-empty span supplies the first match
    in a later span. Both run backwards, where the running minimum is linear.
    """
    cell = [*keys, "_span"]
    if "_rank" not in df.columns:
        return next_seq(ranked(df), keys, wanted, out, span).drop("_rank")
    cut = df.withColumn("_span", F.floor(F.col("_rank") / span)).withColumn(
        "_hit", F.when(F.col(wanted), F.col("seq"))
    )
    within = (
        Window.partitionBy(*cell)
        .orderBy(F.desc("seq"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("_span"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    later = (
        cut.groupBy(*cell)
        .agg(F.min("_hit").alias("_first"))
        .withColumn("_later", F.min("_first").over(across))
        .where(F.col("_later").isNotNull())
        .select(*cell, "_later")
    )
    return (
        cut.withColumn("_next", F.min("_hit").over(within))
        .join(later, cell, "left")
        .withColumn(out, F.coalesce("_next", "_later"))
        .drop("_span", "_hit", "_next", "_later")
    )


@dataclass(frozen=True)
class Replay:
    """Final tables and outcomes of a log."""

    vectors: DataFrame  # id, entity_id, shard_id, seq
    outcomes: DataFrame  # seq, entity_id, shard_id, status_code, message
    marks: DataFrame  # entity_id, shard_id, seq
    graph: DataFrame  # entity_id, shard_id, edges


def replay_request_log(log: DataFrame, span: int = SPAN) -> Replay:
    """Fold a log (seq unique, op 'I' or 'U', entity_id, id, shard_id, n_triplets).

    An unlearn attempt succeeds if, since the entity's previous attempt, some ingest of it had
    a triplet or still owns its slot at the attempt.
    """
    log = ranked(log)
    is_ingest = F.col("op") == "I"
    ingests = log.where(is_ingest).withColumn("_all", F.lit(True))
    ingests = next_seq(ingests, SLOT, "_all", "overwritten", span).drop("_all")
    attempts = log.where(~is_ingest).withColumn("overwritten", F.lit(None).cast("bigint"))
    merged = ingests.unionByName(attempts).withColumn("_attempt", ~is_ingest)
    timeline = next_seq(merged, OWNER, "_attempt", "attempt", span).drop("_attempt")
    timeline = timeline.where(is_ingest)

    counts_for = F.col("attempt").isNotNull() & (
        (F.col("n_triplets") > 0)
        | F.col("overwritten").isNull()
        | (F.col("overwritten") > F.col("attempt"))
    )
    succeeded = (
        timeline.where(counts_for)
        .select(*OWNER, F.col("attempt").alias("seq"))
        .distinct()
        .withColumn("ok", F.lit(True))
    )
    missing = F.format_string(messages.ENTITY_MISSING, F.col("entity_id"))
    outcomes = (
        log.where(~is_ingest)
        .select("seq", *OWNER)
        .join(succeeded, [*OWNER, "seq"], "left")
        .select(
            "seq",
            "entity_id",
            "shard_id",
            F.when(F.col("ok"), F.lit(200)).otherwise(F.lit(404)).alias("status_code"),
            F.when(F.col("ok"), F.lit(messages.UNLEARNED)).otherwise(missing).alias("message"),
        )
    )

    alive = timeline.where(F.col("overwritten").isNull() & F.col("attempt").isNull())
    last_knowledge = (
        log.where(is_ingest & (F.col("n_triplets") > 0))
        .groupBy(*OWNER)
        .agg(F.max("seq").alias("lifted"))
    )
    marks = (
        succeeded.join(last_knowledge, OWNER, "left")
        .where(F.col("lifted").isNull() | (F.col("seq") > F.col("lifted")))
        .select("entity_id", "shard_id", "seq")
    )
    graph = (
        timeline.where(F.col("attempt").isNull() & (F.col("n_triplets") > 0))
        .groupBy("entity_id", "shard_id")
        .agg(F.sum("n_triplets").alias("edges"))
    )
    return Replay(alive.select("id", "entity_id", "shard_id", "seq"), outcomes, marks, graph)
