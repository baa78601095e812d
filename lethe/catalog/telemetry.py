"""Event log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe import messages
from lethe.catalog import query
from lethe.catalog.inputs import EVENTS, LEDGER, SHARDS, event_log, purges, unsigned_ledger
from lethe.operators import telemetry
from lethe.operators.certificates import proof_label
from lethe.operators.search import search_indexed, write_search_index
from lethe.session import new_dir
from lethe.functions.text import short_hash
from lethe.sources.export import receipts

# Views over the events of inputs.EVENTS.
_NODES = f"""{EVENTS},
nodes AS (
  SELECT 'entity_' || entity_id || '_' || id AS node_id, entity_id, id, shard_id, created_seq,
         CASE WHEN gone > created_seq THEN 'purged' ELSE 'active' END AS status
  FROM (SELECT entity_id, id, any_value(shard_id) AS shard_id, min(seq) AS created_seq
        FROM ev WHERE type = 'NodeIngested' GROUP BY entity_id, id)
  LEFT JOIN (SELECT entity_id, max(seq) AS gone FROM ev WHERE type = 'NodeDeleted'
             GROUP BY entity_id) USING (entity_id))"""


@query("emit_events", f"WITH {EVENTS} SELECT seq, ord, type, entity_id, id FROM ev")
def emit_events(spark, sf_dir):
    certificate = F.col("payload.audit_certificate.entity_id")
    return event_log(spark, sf_dir).select(
        "seq",
        "ord",
        "type",
        F.coalesce("payload.entity_id", certificate).alias("entity_id"),
        F.col("payload.id").alias("id"),
    )


@query("event_json", f"WITH {EVENTS} SELECT seq, ord, js AS json FROM ev")
def event_json(spark, sf_dir):
    return event_log(spark, sf_dir).select("seq", "ord", telemetry.event_json().alias("json"))


@query(
    "recent_events",
    f"""WITH {EVENTS} SELECT seq, ord, type, js AS json FROM ev
        ORDER BY seq DESC, ord DESC LIMIT 100""",
)
def recent_events(spark, sf_dir):
    return telemetry.recent_events(event_log(spark, sf_dir)).select(
        "seq", "ord", "type", telemetry.event_json().alias("json")
    )


@query(
    "search_events",
    f"WITH {EVENTS} SELECT seq, ord, type FROM ev WHERE contains(lower(js), 'key_7')",
)
def search_events(spark, sf_dir):
    return telemetry.search_events(event_log(spark, sf_dir), "KEY_7").select(
        "seq", "ord", "type"
    )


@query(
    "search_certificates",
    f"""WITH {LEDGER} SELECT audit_id, entity_id, shard_id, merkle_root_hash FROM ledger
        WHERE contains(lower(entity_id), '_a') OR contains(shard_id::VARCHAR, '_a')
           OR contains(lower(audit_id), '_a') OR contains(lower(merkle_root_hash), '_a')""",
)
def search_certificates(spark, sf_dir):
    """The underscore is literal: it matches audit ids, not any character."""
    return telemetry.search_certificates(unsigned_ledger(spark, sf_dir), "_A").select(
        "audit_id", "entity_id", "shard_id", "merkle_root_hash"
    )


@query(
    "search_certificates_indexed",
    f"""WITH {LEDGER} SELECT audit_id, entity_id, shard_id, merkle_root_hash FROM ledger
        WHERE contains(lower(entity_id), 'user_4') OR contains(shard_id::VARCHAR, 'user_4')
           OR contains(lower(audit_id), 'user_4') OR contains(lower(merkle_root_hash), 'user_4')""",
)
def search_certificates_indexed(spark, sf_dir):
    """The ledger's index is written, then asked."""
    ledger, path = unsigned_ledger(spark, sf_dir), new_dir(spark, "search-index")
    write_search_index(ledger, path)
    return search_indexed(ledger, path, "USER_4").select(
        "audit_id", "entity_id", "shard_id", "merkle_root_hash"
    )


@query(
    "node_state",
    f"""WITH {_NODES} SELECT node_id, entity_id AS label, 'entity' AS type, shard_id,
        entity_id, id, status, created_seq FROM nodes""",
)
def node_state(spark, sf_dir):
    return telemetry.node_state(event_log(spark, sf_dir))


@query(
    "node_links",
    f"""WITH {_NODES} SELECT 'shard_' || shard_id AS source, node_id AS target,
        status <> 'purged' AS visible FROM nodes""",
)
def node_links(spark, sf_dir):
    events = event_log(spark, sf_dir)
    return telemetry.node_links(events, telemetry.node_state(events))


_FEED = f"""{EVENTS}, feed AS (
  SELECT 'audit_' || shard_id || '_' || ep || '_' || substr(h, 1, 8) || '_' || seq AS audit_id,
         seq, entity_id, shard_id, h AS merkle_root_hash, '' AS signature,
         ep AS timestamp_epoch, '{messages.CERTIFIED}' AS status
  FROM ev WHERE type = 'AuditGenerated')"""


@query("certificate_feed", f"WITH {_FEED} SELECT * FROM feed")
def certificate_feed(spark, sf_dir):
    """The log is read twice over, as a client that reconnected would see it."""
    events = event_log(spark, sf_dir)
    return telemetry.certificate_feed(events.unionByName(events))


@query(
    "engine_metrics",
    f"""WITH {_NODES}, root AS (
          SELECT arg_max(h, seq) AS h FROM ev WHERE type = 'AuditGenerated')
        SELECT {SHARDS} AS active_shards, count(*) AS ingested_entities,
          count(*) FILTER (status = 'purged') AS purged_entities,
          (SELECT h FROM root) AS latest_merkle_root,
          (SELECT substr(h, 1, 10) || '...' || substr(h, 57) FROM root) AS short_root
        FROM nodes""",
)
def engine_metrics(spark, sf_dir):
    events = event_log(spark, sf_dir)
    return telemetry.engine_metrics(
        telemetry.node_state(events), telemetry.certificate_feed(events), SHARDS
    )


@query(
    "active_entities",
    f"WITH {_NODES} SELECT DISTINCT entity_id FROM nodes WHERE status = 'active'",
)
def active_entities(spark, sf_dir):
    return telemetry.active_entities(telemetry.node_state(event_log(spark, sf_dir)))


@query(
    "short_hash",
    f"""WITH {LEDGER} SELECT audit_id,
          substr(merkle_root_hash, 1, 10) || '...' || right(merkle_root_hash, 8) AS short_root,
          '{messages.HASH_PLACEHOLDER}' AS short_signature
        FROM ledger""",
)
def short_hashes(spark, sf_dir):
    return unsigned_ledger(spark, sf_dir).select(
        "audit_id",
        short_hash(F.col("merkle_root_hash"), messages.HASH_PLACEHOLDER).alias("short_root"),
        short_hash(F.col("signature"), messages.HASH_PLACEHOLDER).alias("short_signature"),
    )


@query(
    "proof_label",
    f"""WITH {LEDGER} SELECT seq, CASE WHEN toxic = 1 THEN '{messages.PROOF_RECORDED}'
          ELSE '{messages.PROOF_MISSING}' END AS label FROM purge""",
)
def proof_labels(spark, sf_dir):
    """Toxic labels stand for valid verdicts, others for invalid or failed ones."""
    verdict = F.when(F.col("toxic") == 1, F.lit(True)).when(
        F.col("quality") == 1, F.lit(False)
    )
    return purges(spark, sf_dir).select("seq", proof_label(verdict).alias("label"))


_RECEIPT = f"""'{{"audit_id":"' || audit_id || '","entity_id":"' || entity_id ||
  '","shard_id":' || shard_id || ',"merkle_root_hash":"' || merkle_root_hash ||
  '","signature":"","timestamp_epoch":' || timestamp_epoch ||
  ',"status":"{messages.CERTIFIED}"}}'"""


@query(
    "export_receipts",
    f"""WITH {LEDGER} SELECT 'receipt_' || audit_id || '.json' AS file_name,
        {_RECEIPT} AS receipt FROM ledger""",
)
def export_receipts(spark, sf_dir):
    return receipts(unsigned_ledger(spark, sf_dir))
