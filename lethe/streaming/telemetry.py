"""Event streams: node state, certificate feed and metrics kept up to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lethe.operators.telemetry import AUDITED, DELETED, INGESTED

BUCKETS = 64  # slices of the change log, by entity; a batch reads those of its entities

CHANGE = (
    "entity_id string, id string, shard_id int, first_seq long, status string, "
    "new_node int, new_purge int"
)
TOTAL = "bucket int, nodes long, purges long, root_seq long, root string"


def stream_first_ingests(events: DataFrame) -> DataFrame:
    """First ingest per node (update mode), with :func:`stream_last_deletes` the node state
    without Python: state per key lives in the JVM and rows are combined before the shuffle.

    Append each batch's updates to a table; :func:`nodes_from_updates` folds the two tables.
    """
    return (
        events.where(F.col("type") == INGESTED)
        .groupBy(F.col("payload.entity_id").alias("entity_id"), F.col("payload.id").alias("id"))
        .agg(F.min(F.struct("seq", "payload.shard_id")).alias("first"))
        .select("entity_id", "id", "first.shard_id", F.col("first.seq").alias("first_seq"))
    )


def stream_last_deletes(events: DataFrame) -> DataFrame:
    """Newest delete per entity (update mode)."""
    return (
        events.where(F.col("type") == DELETED)
        .groupBy(F.col("payload.entity_id").alias("entity_id"))
        .agg(F.max("seq").alias("deleted"))
    )


def nodes_from_updates(first: DataFrame, deletes: DataFrame) -> DataFrame:
    """Current node state from the updates of both streams."""
    nodes = first.groupBy("entity_id", "id").agg(
        F.min_by("shard_id", "first_seq").alias("shard_id"),
        F.min("first_seq").alias("created_seq"),
    )
    last = deletes.groupBy("entity_id").agg(F.max("deleted").alias("deleted"))
    purged = F.coalesce(F.col("deleted") > F.col("created_seq"), F.lit(False))
    return nodes.join(last, "entity_id", "left").select(
        "entity_id",
        "id",
        "shard_id",
        "created_seq",
        F.when(purged, "purged").otherwise("active").alias("status"),
    )


def _per_node(rows: DataFrame) -> DataFrame:
    """One row per node: its first ingest, and whether it was ever purged."""
    return rows.groupBy("entity_id", "id").agg(
        F.min_by("shard_id", "first_seq").alias("shard_id"),
        F.min("first_seq").alias("first_seq"),
        F.bool_or(F.col("status") == "purged").alias("purged"),
    )


def _per_entity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("entity_id").agg(F.max("first_seq").alias("deleted"))


def _bucket(entity):
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")


def node_changes(events: DataFrame, log: DataFrame) -> DataFrame:
    """Changes that a batch of events makes to the nodes of a change log.

    Least and greatest sequence numbers do not depend on the order of arrival, so late events
    are folded exactly: a node is purged if a delete of its entity comes after its first ingest.
    The log is reduced to the entities of the batch before anything is compared, and only nodes
    whose row differs give one: ``new_node`` and ``new_purge`` are what to add to running
    counts. Newest deletes are kept in the log as rows without an ``id``.
    """
    arrived = events.where(F.col("type").isin(INGESTED, DELETED)).select(
        F.col("payload.entity_id").alias("entity_id"),
        F.when(F.col("type") == INGESTED, F.col("payload.id")).alias("id"),
        F.col("payload.shard_id").alias("shard_id"),
        F.col("seq").alias("first_seq"),
        F.lit("active").alias("status"),
    )
    touched = arrived.select("entity_id").distinct()
    known = log.join(touched, "entity_id", "left_semi")
    is_node = F.col("id").isNotNull()
    new, old = _per_node(arrived.where(is_node)), _per_node(known.where(is_node))
    nodes = new.alias("n").join(old.alias("o"), ["entity_id", "id"], "full")
    earlier = F.col("o.first_seq").isNull() | (F.col("n.first_seq") < F.col("o.first_seq"))
    nodes = nodes.select(
        "entity_id",
        "id",
        F.when(earlier, F.col("n.shard_id")).otherwise(F.col("o.shard_id")).alias("shard_id"),
        F.least("n.first_seq", "o.first_seq").alias("first_seq"),
        F.col("o.first_seq").isNull().alias("appeared"),
        F.coalesce(earlier, F.lit(False)).alias("moved"),
        F.coalesce("o.purged", F.lit(False)).alias("was_purged"),
    )
    before = _per_entity(known.where(~is_node))
    deletes = _per_entity(arrived.where(~is_node))
    newest = before.unionByName(deletes).groupBy("entity_id").agg(F.max("deleted").alias("deleted"))
    purged = F.col("was_purged") | F.coalesce(F.col("deleted") > F.col("first_seq"), F.lit(False))
    judged = nodes.join(newest, "entity_id", "left").withColumn("purged", purged)
    changed = judged.where(
        F.col("appeared") | F.col("moved") | (F.col("purged") & ~F.col("was_purged"))
    ).select(
        "entity_id",
        "id",
        "shard_id",
        "first_seq",
        F.when(F.col("purged"), "purged").otherwise("active").alias("status"),
        F.col("appeared").cast("int").alias("new_node"),
        (F.col("purged") & ~F.col("was_purged")).cast("int").alias("new_purge"),
    )
    marks = (
        deletes.alias("d")
        .join(before.alias("b"), "entity_id", "left")
        .where(F.col("b.deleted").isNull() | (F.col("d.deleted") > F.col("b.deleted")))
        .select("entity_id", F.col("d.deleted").alias("first_seq"))
        .withColumns({"status": F.lit("deleted"), "new_node": F.lit(0), "new_purge": F.lit(0)})
    )
    return changed.unionByName(marks, allowMissingColumns=True)


def _log(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """Change log of the micro-batches before one; the folder has one per batch and bucket."""
    empty = spark.createDataFrame([], f"{CHANGE}, batch int, bucket int")
    if before == 0:
        return empty
    rows = spark.read.schema(empty.schema).parquet(f"{folder}/changes")
    return rows.where(F.col("batch") < before)


def stream_node_changes(events: DataFrame, folder: str) -> DataStreamWriter:
    """Keep the node change log below ``folder`` up to date; start the returned writer with a
    checkpoint and a trigger. :func:`read_node_changes` reads the log, :func:`read_metrics`
    the running totals.

    A micro-batch reads the slices of the log that its entities lie in, and writes its changes
    and totals to folders of its own, so one that runs again replaces what it wrote. Totals are
    those of the batch before plus this batch's signed changes. All of it is plain joins and
    aggregates: a hot entity's nodes meet by node, and its newest delete is a single row.
    """
    spark = events.sparkSession

    def apply(rows: DataFrame, batch: int) -> None:
        entities = rows.where(F.col("type").isin(INGESTED, DELETED)).select("payload.entity_id")
        buckets = [r[0] for r in entities.select(_bucket("entity_id")).distinct().collect()]
        log = _log(spark, folder, batch).where(F.col("bucket").isin(buckets))
        changes = node_changes(rows, log.drop("batch", "bucket"))
        path = f"{folder}/changes/batch={batch}"
        changes.withColumn("bucket", _bucket("entity_id")).write.partitionBy("bucket").mode(
            "overwrite"
        ).parquet(path)
        done = spark.read.schema(f"{CHANGE}, bucket int").parquet(path)
        added = done.groupBy("bucket").agg(
            F.sum("new_node").alias("nodes"), F.sum("new_purge").alias("purges")
        )
        newest = F.max(F.struct("seq", F.col("payload.audit_certificate.merkle_root_hash").alias("root")))
        roots = (
            rows.where(F.col("type") == AUDITED)
            .agg(newest.alias("r"))
            .select(F.lit(-1).alias("bucket"), F.col("r.seq").alias("root_seq"), F.col("r.root").alias("root"))
        )
        parts = [added, roots]
        if batch > 0:
            parts.append(spark.read.schema(TOTAL).parquet(f"{folder}/totals/batch={batch - 1}"))
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        both.groupBy("bucket").agg(
            F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"),
            F.coalesce(F.sum("purges"), F.lit(0)).alias("purges"),
            F.max("root_seq").alias("root_seq"),
            F.max_by("root", "root_seq").alias("root"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals/batch={batch}")

    return events.writeStream.foreachBatch(apply)


def read_node_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The change log, one row whenever a node appears or is purged."""
    rows = spark.read.schema(f"{CHANGE}, batch int, bucket int").parquet(f"{folder}/changes")
    return rows.where(F.col("id").isNotNull()).drop("batch", "bucket")


def read_metrics(spark: SparkSession, folder: str, num_shards: int) -> DataFrame:
    """Header figures after the last micro-batch: one row per slice is added up."""
    rows = spark.read.schema(f"{TOTAL}, batch int").parquet(f"{folder}/totals")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == (-1 if last is None else last)).agg(
        F.lit(num_shards).alias("active_shards"),
        F.coalesce(F.sum("nodes"), F.lit(0)).alias("ingested_entities"),
        F.coalesce(F.sum("purges"), F.lit(0)).alias("purged_entities"),
        F.coalesce(F.max_by("root", "root_seq"), F.lit("")).alias("latest_merkle_root"),
    )


def nodes_from_changes(changes: DataFrame) -> DataFrame:
    """Current node state from the change log: the earliest ingest, purged once purged."""
    return changes.groupBy("entity_id", "id").agg(
        F.min_by("shard_id", "first_seq").alias("shard_id"),
        F.min("first_seq").alias("created_seq"),
        F.when(F.bool_or(F.col("status") == "purged"), "purged")
        .otherwise("active")
        .alias("status"),
    )


def stream_certificates(events: DataFrame) -> DataFrame:
    """Certificates as they appear, each audit id once.

    Audit ids are remembered for good. Where ``events`` has a watermark, pass it on with
    :func:`stream_certificates_within` to bound that state.
    """
    return _certificates(events).dropDuplicates(["audit_id"])


def stream_certificates_within(events: DataFrame, time: str, delay: str) -> DataFrame:
    """As :func:`stream_certificates`, forgetting ids once the watermark has passed them."""
    timed = _certificates(events, time).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(["audit_id"])


def _certificates(events: DataFrame, *extra: str) -> DataFrame:
    seen = events.where(F.col("type") == AUDITED)
    return seen.select("seq", *extra, "payload.audit_certificate.*")
