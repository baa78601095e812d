"""The streaming forms, run over the given tables until no input is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe import messages
from lethe.catalog import query
from lethe.catalog.inputs import (
    DEMO_KEY,
    EPOCH,
    REQ,
    SHARDS,
    TOXIC,
    document_requests,
    event_log_of,
    sql_shard,
    table,
    text_of,
    user,
)
from lethe.catalog.jobs import _MISSING, new_store
from lethe.catalog.telemetry import _FEED, _NODES
from lethe.plans.ingest import run_ingest_batch
from lethe.session import new_dir
from lethe.streaming import requests as request_streams
from lethe.streaming import telemetry


def stream_table(spark, sf_dir, name):
    """A given table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(sf_dir)
    )


def drain(spark, writer) -> None:
    """Run a stream over all the input there is."""
    writer = writer.option("checkpointLocation", new_dir(spark, "stream"))
    writer.trigger(availableNow=True).start().awaitTermination()


def to_files(spark, df, mode="append"):
    path = new_dir(spark, "sink")
    drain(spark, df.writeStream.outputMode(mode).format("parquet").option("path", path))
    return spark.read.schema(df.schema).parquet(path)


@query(
    "stream_ingest",
    f"""WITH {REQ} SELECT id, entity_id, {sql_shard("entity_id")} AS shard_id,
        true AS unit_length FROM req""",
)
def stream_ingest(spark, sf_dir):
    docs = stream_table(spark, sf_dir, "documents").select(
        text_of("b_", F.expr("doc_id div 50")).alias("batch_id"),
        F.col("doc_id").alias("seq"),
        text_of("doc_", F.col("doc_id")).alias("id"),
        user(F.col("doc_id")).alias("entity_id"),
        "text",
    )
    store = new_store(spark)
    drain(
        spark,
        request_streams.stream_ingest(docs, store, "ingest", clock=lambda batch: EPOCH + batch),
    )
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return store.read("vectors").select(
        "id", "entity_id", "shard_id", (F.abs(norm - 1) < 1e-3).alias("unit_length")
    )


@query(
    "stream_unlearn",
    f"""WITH {REQ}, {TOXIC},
        judged AS (SELECT *, entity_id IN (SELECT entity_id FROM req)
                   AND seq = min(seq) OVER (PARTITION BY entity_id) AS ok FROM toxic)
        SELECT seq, entity_id, shard_id, CASE WHEN ok THEN 200 ELSE 404 END AS status_code,
          CASE WHEN ok THEN '{messages.UNLEARNED}' ELSE {_MISSING} END AS message,
          CAST({EPOCH} AS BIGINT) AS timestamp_epoch FROM judged""",
)
def stream_unlearn(spark, sf_dir):
    store = new_store(spark)
    run_ingest_batch(store, document_requests(spark, sf_dir), EPOCH)
    labels = (
        stream_table(spark, sf_dir, "labels")
        .where(F.col("toxic") == 1)
        .select(
            text_of("b_", F.expr("doc_id div 50")).alias("batch_id"),
            F.col("doc_id").alias("seq"),
            user(F.col("doc_id")).alias("entity_id"),
        )
    )
    drain(
        spark,
        request_streams.stream_unlearn(
            labels, store, "unlearn", clock=lambda batch: EPOCH, private_key=DEMO_KEY
        ),
    )
    return store.read("unlearn_log").select(
        "seq", "entity_id", "shard_id", "status_code", "message", "timestamp_epoch"
    )


def update_files(spark, df):
    """Updates of an aggregating stream, appended batch by batch.

    Every batch has a folder of its own, so a batch that runs again replaces what it wrote.
    """
    path = new_dir(spark, "updates")

    def append(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    drain(spark, df.writeStream.outputMode("update").foreachBatch(append))
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@query(
    "stream_node_state",
    f"WITH {_NODES} SELECT entity_id, id, shard_id, created_seq, status FROM nodes",
)
def stream_node_state(spark, sf_dir):
    events = event_log_of(stream_table(spark, sf_dir, "events"))
    first = update_files(spark, telemetry.stream_first_ingests(events))
    deletes = update_files(spark, telemetry.stream_last_deletes(events))
    return telemetry.nodes_from_updates(first, deletes)


def _folded(spark, sf_dir) -> str:
    """Folder of the change log and totals after the whole event log."""
    events = event_log_of(stream_table(spark, sf_dir, "events"))
    folder = new_dir(spark, "nodes")
    drain(spark, telemetry.stream_node_changes(events, folder))
    return folder


@query(
    "stream_node_changes",
    f"WITH {_NODES} SELECT entity_id, id, shard_id, created_seq, status FROM nodes",
)
def stream_node_changes(spark, sf_dir):
    changes = telemetry.read_node_changes(spark, _folded(spark, sf_dir))
    return telemetry.nodes_from_changes(changes)


@query("stream_certificate_dedup", f"WITH {_FEED} SELECT * FROM feed")
def stream_certificate_dedup(spark, sf_dir):
    events = event_log_of(stream_table(spark, sf_dir, "events"))
    return to_files(spark, telemetry.stream_certificates(events.unionByName(events)))


@query(
    "stream_metrics",
    f"""WITH {_NODES}, root AS (
          SELECT arg_max(h, seq) AS h FROM ev WHERE type = 'AuditGenerated')
        SELECT {SHARDS} AS active_shards, count(*) AS ingested_entities,
          count(*) FILTER (status = 'purged') AS purged_entities,
          (SELECT h FROM root) AS latest_merkle_root FROM nodes""",
)
def stream_metrics(spark, sf_dir):
    """Running totals, to which every micro-batch adds its changes."""
    return telemetry.read_metrics(spark, _folded(spark, sf_dir), SHARDS)
