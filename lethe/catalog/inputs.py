"""The given tables seen as requests, vectors, logs and ledgers, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe import messages
from lethe.functions.hashing import assign_shard
from lethe.operators.certificates import unsigned_certificates
from lethe.operators.telemetry import ingest_events, unlearn_events
from lethe.operators.triplets import extract_triplets, triplet_rows

SHARDS = 4
DIMENSION = 64
EPOCH = 1_700_000_000
ENTITIES = 97  # distinct entities the documents are shared out to
DEMO_KEY = bytes(range(32))  # signing key of the registered queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The given files are single; deal their rows out to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


TASK_BYTES = 16 << 20


def spread_by_size(df: DataFrame) -> DataFrame:
    """Rows of files dealt out to tasks of a bounded share of their bytes, one per core at least.

    By a hash of all columns, as dealing rows out in turn sorts what each task has read first.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    tasks = -(-sum(int(size) for size in sizes) // TASK_BYTES)
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, tasks), *df.columns)


def text_of(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def user(number: Column) -> Column:
    return text_of("user_", number % ENTITIES)


def sharded(df: DataFrame) -> DataFrame:
    return df.withColumn("shard_id", assign_shard(F.col("entity_id"), SHARDS))


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest requests of the documents, fifty to a batch."""
    return table(spark, sf_dir, "documents").select(
        text_of("b_", F.expr("doc_id div 50")).alias("batch_id"),
        F.col("doc_id").alias("seq"),
        text_of("doc_", F.col("doc_id")).alias("id"),
        user(F.col("doc_id")).alias("entity_id"),
        "text",
    )


def toxic_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlearn requests: the owners of documents labelled toxic."""
    return sharded(
        table(spark, sf_dir, "labels")
        .where(F.col("toxic") == 1)
        .select(
            text_of("b_", F.expr("doc_id div 50")).alias("batch_id"),
            F.col("doc_id").alias("seq"),
            user(F.col("doc_id")).alias("entity_id"),
        )
    )


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(
        table(spark, sf_dir, "embeddings").select(
            text_of("vec_", F.col("vec_id")).alias("id"),
            user(F.col("vec_id")).alias("entity_id"),
            F.col("embedding").alias("vector"),
        )
    ).select("id", "entity_id", "vector", "shard_id")


def document_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplet rows of all documents with their entity and shard."""
    docs = spread(document_requests(spark, sf_dir))
    rows = triplet_rows(extract_triplets(docs), "seq", "id", "entity_id")
    return sharded(rows)


def benchmark_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "benchmark")).select(
        F.col("item_id").alias("seq"), user(F.col("item_id")).alias("entity_id"), "text"
    )
    return sharded(triplet_rows(extract_triplets(docs), "seq", "entity_id"))


def purges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One purge per label, so most entities are purged several times."""
    return sharded(
        table(spark, sf_dir, "labels").select(
            user(F.col("doc_id")).alias("entity_id"),
            (F.lit(EPOCH) + F.expr("doc_id div 7")).alias("timestamp_epoch"),
            F.col("doc_id").alias("seq"),
            F.col("quality"),
            F.col("toxic"),
        )
    )


def unsigned_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unsigned_certificates(purges(spark, sf_dir)).withColumn("signature", F.lit(""))
    return rows.select(
        "audit_id",
        "entity_id",
        "shard_id",
        "merkle_root_hash",
        "signature",
        "timestamp_epoch",
        "status",
        "seq",
    )


def request_log(spark: SparkSession, sf_dir: str, shared_ids: bool) -> DataFrame:
    return request_log_of(table(spark, sf_dir, "events"), shared_ids)


def request_log_of(events: DataFrame, shared_ids: bool) -> DataFrame:
    """Mixed log: errors unlearn the user, everything else ingests.

    Views have no triplets. With ``shared_ids`` documents are named by a property that many
    events share, so requests of several entities meet on one slot.
    """
    key = F.get_json_object("props", "$.k")
    name = text_of("key_", key) if shared_ids else text_of("ev_", F.col("event_id"))
    return sharded(
        events.select(
            F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "error", "U").otherwise("I").alias("op"),
            text_of("u_", F.col("user_id")).alias("entity_id"),
            F.when(F.col("event_type") != "error", name).alias("id"),
            F.when(F.col("event_type").isin("error", "view"), 0)
            .when(F.col("event_type") == "purchase", 2)
            .otherwise(1)
            .alias("n_triplets"),
        )
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log_of(table(spark, sf_dir, "events"))


def event_log_of(events: DataFrame) -> DataFrame:
    """Engine events of the log with shared ids, every unlearn taken as successful."""
    log = request_log_of(events, shared_ids=True)
    certificates = unsigned_certificates(
        log.where(F.col("op") == "U").withColumn(
            "timestamp_epoch", F.lit(EPOCH) + F.expr("seq div 10")
        )
    ).withColumn("signature", F.lit(""))
    return ingest_events(log.where(F.col("op") == "I")).unionByName(
        unlearn_events(certificates)
    )


# The same views in DuckDB's SQL.


def sql_shard(entity: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256({entity}), 1, 8) AS BIGINT) % {SHARDS} AS INTEGER)"


def sql_hash(entity: str, shard: str, epoch: str) -> str:
    return f"sha256({entity} || ':' || {shard} || ':' || {epoch})"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


REQ = f"""req AS (
  SELECT 'b_' || (doc_id // 50) AS batch_id, doc_id AS seq, 'doc_' || doc_id AS id,
         'user_' || (doc_id % {ENTITIES}) AS entity_id, text FROM documents)"""

TOXIC = f"""toxic AS (
  SELECT *, {sql_shard("entity_id")} AS shard_id FROM (
    SELECT 'b_' || (doc_id // 50) AS batch_id, doc_id AS seq,
           'user_' || (doc_id % {ENTITIES}) AS entity_id FROM labels WHERE toxic = 1))"""

VEC = f"""vec AS (
  SELECT *, {sql_shard("entity_id")} AS shard_id FROM (
    SELECT 'vec_' || vec_id AS id, 'user_' || (vec_id % {ENTITIES}) AS entity_id,
           embedding AS vector FROM embeddings))"""

LEDGER = f"""purge AS (
  SELECT *, {sql_shard("entity_id")} AS shard_id FROM (
    SELECT 'user_' || (doc_id % {ENTITIES}) AS entity_id,
           {EPOCH} + doc_id // 7 AS timestamp_epoch, doc_id AS seq, quality, toxic
    FROM labels)),
ledger AS (
  SELECT 'audit_' || shard_id || '_' || timestamp_epoch || '_' || substr(h, 1, 8) || '_' || seq
           AS audit_id, entity_id, shard_id, h AS merkle_root_hash, '' AS signature,
         timestamp_epoch, '{messages.CERTIFIED}' AS status, seq
  FROM (SELECT *, {sql_hash("entity_id", "shard_id", "timestamp_epoch")} AS h FROM purge))"""


def sql_log(shared_ids: bool) -> str:
    name = "'key_' || json_extract_string(props, '$.k')" if shared_ids else "'ev_' || event_id"
    return f"""log AS (
  SELECT *, {sql_shard("entity_id")} AS shard_id FROM (
    SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'U' ELSE 'I' END AS op,
           'u_' || user_id AS entity_id,
           CASE WHEN event_type <> 'error' THEN {name} END AS id,
           CASE WHEN event_type IN ('error', 'view') THEN 0 WHEN event_type = 'purchase' THEN 2
                ELSE 1 END AS n_triplets
    FROM events))"""


_CERT = f"""'{{"audit_id":"audit_' || shard_id || '_' || ep || '_' || substr(h, 1, 8) || '_' ||
  seq || '","entity_id":"' || entity_id || '","shard_id":' || shard_id ||
  ',"merkle_root_hash":"' || h || '","signature":"","timestamp_epoch":' || ep ||
  ',"status":"{messages.CERTIFIED}"}}'"""

# Engine events with their wire form.
EVENTS = f"""{sql_log(True)},
del AS (SELECT *, {sql_hash("entity_id", "shard_id", "ep")} AS h
        FROM (SELECT *, {EPOCH} + seq // 10 AS ep FROM log WHERE op = 'U')),
ev AS (
  SELECT seq, 0 AS ord, 'NodeIngested' AS type, id, entity_id, shard_id, NULL AS h, NULL AS ep,
    '{{"type":"NodeIngested","payload":{{"id":"' || id || '","entity_id":"' || entity_id ||
    '","shard_id":' || shard_id || '}}}}' AS js FROM log WHERE op = 'I'
  UNION ALL
  SELECT seq, 0, 'NodeDeleted', NULL, entity_id, shard_id, NULL, NULL,
    '{{"type":"NodeDeleted","payload":{{"entity_id":"' || entity_id || '","shard_id":' ||
    shard_id || '}}}}' FROM del
  UNION ALL
  SELECT seq, 1, 'AuditGenerated', NULL, entity_id, shard_id, h, ep,
    '{{"type":"AuditGenerated","payload":{{"audit_certificate":' || {_CERT} || '}}}}' FROM del)"""
