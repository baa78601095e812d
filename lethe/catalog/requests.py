"""Sources, validation, search-free predicates and sharding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe import messages
from lethe.catalog import query
from lethe.catalog.inputs import (
    ENTITIES,
    REQ,
    SHARDS,
    document_requests,
    sql_shard,
    sql_text,
    table,
    text_of,
    user,
)
from lethe.functions.hashing import assign_shard
from lethe.functions.text import error_message, non_blank, valid_identifier
from lethe.operators import shards, validate
from lethe.session import new_dir
from lethe.sources.requests import read_ingest_payloads, read_unlearn_payloads

_ID = r"^[a-zA-Z0-9_-]{3,64}$"
_BLANK = r"[^\s\p{Z}\x{0B}\x{85}]"
_SQL_OK = f"regexp_full_match(value, '[a-zA-Z0-9_-]{{3,64}}')"


def ingest_lines(spark, sf_dir) -> str:
    """A folder of text files with one ingest payload per turn: objects of user turns, arrays
    of two requests for the others."""
    turn = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))

    def request(prefix):
        return F.struct(
            F.concat(F.lit(prefix), turn).alias("id"),
            text_of("conv_", F.col("conv_id")).alias("entity_id"),
            "text",
        )

    payload = F.when(F.col("role") == "user", F.to_json(request("turn_"))).otherwise(
        F.to_json(F.array(request("turn_"), request("copy_")))
    )
    path = new_dir(spark, "payloads")
    table(spark, sf_dir, "conversations").select(payload).write.text(path)
    return path


def unlearn_lines(spark, sf_dir) -> str:
    """A folder of text files with one unlearn payload per label."""
    entity = user(F.col("doc_id"))
    payload = F.when(
        F.col("toxic") == 1, F.to_json(F.struct(entity.alias("entity_id")))
    ).otherwise(F.to_json(F.array(entity, text_of("owner_", F.col("doc_id")))))
    path = new_dir(spark, "payloads")
    table(spark, sf_dir, "labels").select(payload).write.text(path)
    return path


@query(
    "read_ingest_requests",
    """SELECT 0 AS item, 'turn_' || conv_id || '_' || turn AS id,
              'conv_' || conv_id AS entity_id, text FROM conversations
       UNION ALL
       SELECT 1, 'copy_' || conv_id || '_' || turn, 'conv_' || conv_id, text
       FROM conversations WHERE role <> 'user'""",
)
def read_ingest_requests(spark, sf_dir):
    found = read_ingest_payloads(spark, ingest_lines(spark, sf_dir))
    return found.requests.select("item", "id", "entity_id", "text")


@query(
    "read_unlearn_requests",
    f"""SELECT 0 AS item, 'user_' || (doc_id % {ENTITIES}) AS entity_id FROM labels
        UNION ALL
        SELECT 1, 'owner_' || doc_id FROM labels WHERE toxic = 0""",
)
def read_unlearn_requests(spark, sf_dir):
    found = read_unlearn_payloads(spark, unlearn_lines(spark, sf_dir))
    return found.requests.select("item", "entity_id")


def _candidates(spark, sf_dir):
    """Values of every kind: good ids, short ids, URLs and whole texts."""
    parts = [
        ("documents", "doc_id", text_of("doc_", F.col("doc_id"))),
        ("events", "event_id", text_of("u", F.col("user_id"))),
        ("pages", "page_id", F.col("url")),
        ("benchmark", "item_id", F.col("text")),
    ]
    rows = None
    for name, key, value in parts:
        part = table(spark, sf_dir, name).select(
            F.lit(name).alias("source"), F.col(key).alias("key"), value.alias("value")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


_CANDIDATES = """cand AS (
  SELECT 'documents' AS source, doc_id AS key, 'doc_' || doc_id AS value FROM documents
  UNION ALL SELECT 'events', event_id, 'u' || user_id FROM events
  UNION ALL SELECT 'pages', page_id, url FROM pages
  UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)"""


@query(
    "valid_identifier",
    f"WITH {_CANDIDATES} SELECT source, key, {_SQL_OK} AS valid FROM cand",
)
def identifiers(spark, sf_dir):
    return _candidates(spark, sf_dir).select(
        "source", "key", valid_identifier(F.col("value")).alias("valid")
    )


_LINES = """lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def document_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")
    )


@query(
    "non_blank",
    f"""WITH {_LINES} SELECT doc_id, CAST(line AS INTEGER) AS line,
        regexp_matches(text, '{_BLANK}') AS filled FROM lines""",
)
def blank_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).select(
        "doc_id", "line", non_blank(F.col("text")).alias("filled")
    )


def _mixed_requests(spark, sf_dir):
    """Documents and conversations (valid), pages (bad id) and events (short entity)."""
    parts = [
        ("documents", "doc_id", text_of("doc_", F.col("doc_id")), user(F.col("doc_id")), "text"),
        ("pages", "page_id", F.col("url"), text_of("site_", F.col("page_id")), "html"),
        (
            "conversations",
            "conv_id",
            F.concat_ws("_", F.lit("turn"), F.col("conv_id").cast("string"), "role"),
            text_of("conv_", F.col("conv_id")),
            "text",
        ),
        (
            "events",
            "event_id",
            text_of("ev_", F.col("event_id")),
            text_of("u", F.col("user_id")),
            "props",
        ),
    ]
    rows = None
    for name, key, request_id, entity, text in parts:
        part = table(spark, sf_dir, name).select(
            F.lit(name).alias("source"),
            F.col(key).alias("key"),
            request_id.alias("id"),
            entity.alias("entity_id"),
            F.col(text).alias("text"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


_MIXED = f"""mixed AS (
  SELECT 'documents' AS source, doc_id AS key, 'doc_' || doc_id AS id,
         'user_' || (doc_id % {ENTITIES}) AS entity_id, text FROM documents
  UNION ALL SELECT 'pages', page_id, url, 'site_' || page_id, html FROM pages
  UNION ALL SELECT 'conversations', conv_id, 'turn_' || conv_id || '_' || role,
                   'conv_' || conv_id, text FROM conversations
  UNION ALL SELECT 'events', event_id, 'ev_' || event_id, 'u' || user_id, props FROM events)"""


def _sql_ingest_error(id_: str, entity: str, text: str) -> str:
    return f"""CASE
      WHEN NOT regexp_matches({text}, '{_BLANK}') OR NOT regexp_matches({entity}, '{_BLANK}')
        THEN {sql_text(messages.INGEST_BLANK)}
      WHEN NOT regexp_matches({id_}, '{_ID}') OR NOT regexp_matches({entity}, '{_ID}')
        THEN {sql_text(messages.INGEST_INVALID)} END"""


@query(
    "classify_ingest",
    f"""WITH {_MIXED} SELECT source, key, id,
        CASE WHEN message IS NULL THEN 200 ELSE 400 END AS status_code, message
        FROM (SELECT *, {_sql_ingest_error("id", "entity_id", "text")} AS message FROM mixed)""",
)
def classify_ingest(spark, sf_dir):
    return validate.classify_ingest(_mixed_requests(spark, sf_dir)).select(
        "source", "key", "id", "status_code", "message"
    )


_BATCHED = f"""batched AS (
  SELECT 'b_' || (doc_id // 50) AS batch_id, 2 * doc_id AS seq, 'doc_' || doc_id AS id,
         'user_' || (doc_id % {ENTITIES}) AS entity_id, text FROM documents
  UNION ALL SELECT 'b_' || (page_id // 50), 2 * page_id + 1, url, 'site_' || page_id, html
  FROM pages)"""


def _batched(spark, sf_dir):
    docs = document_requests(spark, sf_dir).withColumn("seq", F.col("seq") * 2)
    pages = table(spark, sf_dir, "pages").select(
        text_of("b_", F.expr("page_id div 50")).alias("batch_id"),
        (F.col("page_id") * 2 + 1).alias("seq"),
        F.col("url").alias("id"),
        text_of("site_", F.col("page_id")).alias("entity_id"),
        F.col("html").alias("text"),
    )
    return docs.unionByName(pages)


@query(
    "reject_bad_ingest_batch",
    f"""WITH {_BATCHED}, checked AS (
          SELECT *, {_sql_ingest_error("id", "entity_id", "text")} AS message FROM batched),
        bad AS (SELECT batch_id, arg_min(message, seq) AS message FROM checked
                WHERE message IS NOT NULL GROUP BY batch_id),
        size AS (SELECT batch_id, count(*) AS size FROM batched GROUP BY batch_id)
        SELECT batch_id, size, CASE WHEN message IS NULL THEN 200 ELSE 400 END AS status_code,
               message FROM size LEFT JOIN bad USING (batch_id)""",
)
def reject_bad_ingest_batch(spark, sf_dir):
    return validate.ingest_batch_verdicts(_batched(spark, sf_dir))


@query(
    "accepted_ingest_requests",
    f"""WITH {_BATCHED}, bad AS (
          SELECT DISTINCT batch_id FROM batched
          WHERE {_sql_ingest_error("id", "entity_id", "text")} IS NOT NULL)
        SELECT batch_id, seq, id, entity_id FROM batched
        WHERE batch_id NOT IN (SELECT batch_id FROM bad)""",
)
def accepted_ingest_requests(spark, sf_dir):
    rows = _batched(spark, sf_dir)
    kept = validate.accepted(rows, validate.ingest_batch_verdicts(rows))
    return kept.select("batch_id", "seq", "id", "entity_id")


def _short_unlearns(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        text_of("b_", F.expr("event_id div 20")).alias("batch_id"),
        F.col("event_id").alias("seq"),
        text_of("u", F.col("user_id")).alias("entity_id"),
    )


@query(
    "classify_unlearn",
    f"""SELECT event_id AS seq, 'u' || user_id AS entity_id,
        CASE WHEN bad THEN 400 ELSE 200 END AS status_code,
        CASE WHEN bad THEN '{messages.INVALID_INPUT}' END AS error,
        CASE WHEN bad THEN {sql_text(messages.UNLEARN_INVALID)} END AS message
        FROM (SELECT *, NOT regexp_matches('u' || user_id, '{_ID}') AS bad FROM events)""",
)
def classify_unlearn(spark, sf_dir):
    return validate.classify_unlearn(_short_unlearns(spark, sf_dir)).select(
        "seq", "entity_id", "status_code", "error", "message"
    )


_QUOTED = " || entity_id || ".join(sql_text(p) for p in messages.UNLEARN_INVALID_ITEM.split("%s"))


@query(
    "reject_bad_unlearn_batch",
    f"""WITH r AS (SELECT 'b_' || (event_id // 20) AS batch_id, event_id AS seq,
                          'u' || user_id AS entity_id FROM events),
        bad AS (SELECT batch_id, arg_min({_QUOTED}, seq) AS message FROM r
                WHERE NOT regexp_matches(entity_id, '{_ID}') GROUP BY batch_id),
        size AS (SELECT batch_id, count(*) AS size FROM r GROUP BY batch_id)
        SELECT batch_id, size, CASE WHEN message IS NULL THEN 200 ELSE 400 END AS status_code,
               message FROM size LEFT JOIN bad USING (batch_id)""",
)
def reject_bad_unlearn_batch(spark, sf_dir):
    return validate.unlearn_batch_verdicts(_short_unlearns(spark, sf_dir))


@query(
    "embed_input_check",
    f"""WITH {_LINES}
        SELECT 'doc_' || doc_id AS batch_id, count(*) AS size,
          CASE WHEN bool_and(regexp_matches(text, '{_BLANK}')) THEN 200 ELSE 400 END
            AS status_code,
          CASE WHEN NOT bool_and(regexp_matches(text, '{_BLANK}'))
            THEN {sql_text(messages.EMBED_BLANK_BATCH)} END AS message
        FROM lines GROUP BY doc_id""",
)
def embed_input_check(spark, sf_dir):
    items = document_lines(spark, sf_dir).select(
        text_of("doc_", F.col("doc_id")).alias("batch_id"), F.col("line").alias("seq"), "text"
    )
    return validate.embed_batch_verdicts(items)


@query(
    "vector_dim_check",
    """WITH v AS (SELECT 'vec_' || vec_id AS id, 'label_' || label AS entity_id,
                 len(embedding) + (CASE WHEN label % 2 = 1 THEN 1 ELSE 0 END) AS actual
                 FROM embeddings)
       SELECT id, entity_id, 64 AS expected, CAST(actual AS INTEGER) AS actual,
              'Vector dimension mismatch: expected 64, got ' || actual AS message
       FROM v WHERE actual <> 64""",
)
def vector_dim_check(spark, sf_dir):
    longer = F.concat("embedding", F.array(F.lit(0.0).cast("float")))
    rows = table(spark, sf_dir, "embeddings").select(
        text_of("vec_", F.col("vec_id")).alias("id"),
        text_of("label_", F.col("label")).alias("entity_id"),
        F.when(F.col("label") % 2 == 1, longer).otherwise(F.col("embedding")).alias("vector"),
    )
    return validate.vector_dim_check(rows, 64)


@query(
    "assign_shard",
    f"WITH {REQ} SELECT id, entity_id, {sql_shard('entity_id')} AS shard_id FROM req",
)
def shard_of_documents(spark, sf_dir):
    return document_requests(spark, sf_dir).select(
        "id", "entity_id", assign_shard(F.col("entity_id"), SHARDS).alias("shard_id")
    )


@query(
    "shard_topology",
    f"""WITH {REQ}, placed AS (SELECT entity_id, {sql_shard('entity_id')} AS shard_id FROM req)
        SELECT CAST(s.range AS INTEGER) AS shard_id, 'shard_' || s.range AS node_id,
               count(entity_id) AS docs, count(DISTINCT entity_id) AS entities
        FROM range({SHARDS}) s LEFT JOIN placed ON placed.shard_id = s.range
        GROUP BY s.range""",
)
def shard_topology(spark, sf_dir):
    return shards.shard_topology(document_requests(spark, sf_dir), SHARDS)


@query(
    "topology_links",
    f"""WITH {REQ} SELECT 'shard_' || {sql_shard('entity_id')} AS source,
        'entity_' || entity_id || '_' || id AS target FROM req""",
)
def topology_links(spark, sf_dir):
    return shards.topology_links(document_requests(spark, sf_dir), SHARDS)


@query(
    "error_message",
    f"""SELECT event_id, CASE
          WHEN regexp_matches('u' || user_id, '{_ID}') THEN 'Unlearn failed'
          WHEN event_id % 2 = 0 THEN {_QUOTED}
          ELSE {sql_text(messages.UNLEARN_INVALID)} END AS shown
        FROM (SELECT *, 'u' || user_id AS entity_id FROM events)""",
)
def shown_errors(spark, sf_dir):
    """Bodies of rejected unlearn requests: plain text from batches, JSON from single ones."""
    judged = validate.classify_unlearn(_short_unlearns(spark, sf_dir))
    body = F.when(F.col("message").isNull(), F.lit("")).otherwise(
        F.when(
            F.col("seq") % 2 == 0, validate.unlearn_item_error(F.col("entity_id"))
        ).otherwise(F.to_json(F.struct("error", "message")))
    )
    return judged.select(
        F.col("seq").alias("event_id"), error_message(body, "Unlearn failed").alias("shown")
    )
