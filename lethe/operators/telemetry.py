"""Event log: emission, wire form, search and the views folded from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe import messages, schemas
from lethe.functions.text import contains_folded, short_hash

INGESTED, DELETED, AUDITED = "NodeIngested", "NodeDeleted", "AuditGenerated"
_PAYLOAD = schemas.EVENT["payload"].dataType


def _payload(**given: Column) -> Column:
    return F.struct(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in _PAYLOAD.fields
        ]
    )


def ingest_events(ingested: DataFrame) -> DataFrame:
    """One event per ingested row (seq, id, entity_id, shard_id)."""
    payload = _payload(**{c: F.col(c) for c in ("id", "entity_id", "shard_id")})
    return ingested.select(
        "seq", F.lit(0).alias("ord"), F.lit(INGESTED).alias("type"), payload.alias("payload")
    )


def unlearn_events(certificates: DataFrame) -> DataFrame:
    """Deletion then certificate, for every certificate row (with its request ``seq``)."""
    deleted = _payload(entity_id=F.col("entity_id"), shard_id=F.col("shard_id"))
    certificate = F.struct(*[F.col(c) for c in schemas.CERTIFICATE.fieldNames()])
    pair = [
        F.struct(F.lit(0).alias("ord"), F.lit(DELETED).alias("type"), deleted.alias("payload")),
        F.struct(
            F.lit(1).alias("ord"),
            F.lit(AUDITED).alias("type"),
            _payload(audit_certificate=certificate).alias("payload"),
        ),
    ]
    return certificates.select("seq", F.explode(F.array(*pair)).alias("e")).select(
        "seq", "e.*"
    )


def event_json() -> Column:
    """Wire form ``{"type": …, "payload": {…}}``; absent members are left out."""
    return F.to_json(F.struct("type", "payload"))


def recent_events(events: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` events, newest first (a top-k, not a full sort)."""
    return events.orderBy(F.desc("seq"), F.desc("ord")).limit(n)


def stamp_events(events: DataFrame, now: Column) -> DataFrame:
    """Events without a timestamp get the given one."""
    have = F.col("timestamp") if "timestamp" in events.columns else F.lit(None)
    return events.withColumn("timestamp", F.coalesce(have.cast("timestamp"), now))


def search_events(events: DataFrame, query: str) -> DataFrame:
    """Events whose wire form contains the query, ignoring case; a blank query keeps all."""
    return events.where(contains_folded(event_json(), query)) if query.strip() else events


SEARCHED = ("entity_id", "shard_id", "audit_id", "merkle_root_hash")


def search_certificates(ledger: DataFrame, query: str) -> DataFrame:
    """Certificates whose entity, shard, audit id or hash contains the query."""
    if not query.strip():
        return ledger
    hit = F.lit(False)
    for name in SEARCHED:
        hit = hit | contains_folded(F.col(name).cast("string"), query)
    return ledger.where(hit)


def _ingests(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == INGESTED).select("seq", "ord", "payload.*")


def node_state(events: DataFrame) -> DataFrame:
    """Nodes of the view: created by the first ingest, purged by any later delete of the
    entity, and never revived by a repeated ingest."""
    first = (
        _ingests(events)
        .groupBy("entity_id", "id")
        .agg(F.min(F.struct("seq", "ord", "shard_id")).alias("first"))
    )
    last_delete = (
        events.where(F.col("type") == DELETED)
        .groupBy(F.col("payload.entity_id").alias("entity_id"))
        .agg(F.max(F.struct("seq", "ord")).alias("deleted"))
    )
    # Nodes stay the streamed side; deletes have one row per entity.
    joined = first.join(last_delete, "entity_id", "left")
    purged = F.col("deleted") > F.struct("first.seq", "first.ord")
    return joined.select(
        F.concat_ws("_", F.lit("entity"), "entity_id", "id").alias("node_id"),
        F.col("entity_id").alias("label"),
        F.lit("entity").alias("type"),
        F.col("first.shard_id").alias("shard_id"),
        "entity_id",
        "id",
        F.when(F.coalesce(purged, F.lit(False)), "purged").otherwise("active").alias("status"),
        F.col("first.seq").alias("created_seq"),
    )


def node_links(events: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct hub-to-node links. With ``nodes``, adds ``visible``: a purged node's link is
    kept but not drawn."""
    links = _ingests(events).select("shard_id", "entity_id", "id").distinct()
    named = links.select(
        F.concat(F.lit("shard_"), F.col("shard_id").cast("string")).alias("source"),
        F.concat_ws("_", F.lit("entity"), "entity_id", "id").alias("target"),
        "entity_id",
        "id",
    )
    if nodes is None:
        return named.select("source", "target")
    status = nodes.select("entity_id", "id", (F.col("status") != "purged").alias("visible"))
    return named.join(status, ["entity_id", "id"]).select("source", "target", "visible")


def certificate_feed(events: DataFrame) -> DataFrame:
    """Certificates seen in the event log, the first sighting of each audit id."""
    seen = events.where(F.col("type") == AUDITED)
    return (
        seen.select("seq", "ord", "payload.audit_certificate.*")
        .groupBy("audit_id")
        .agg(
            F.min_by(
                F.struct("seq", *schemas.CERTIFICATE.fieldNames()[1:]),
                F.struct("seq", "ord"),
            ).alias("c")
        )
        .select("audit_id", "c.*")
    )


def engine_metrics(nodes: DataFrame, feed: DataFrame, num_shards: int) -> DataFrame:
    """The header figures, one row: both inputs go through one aggregate."""
    none = F.lit(None)
    rows = nodes.select(
        F.lit(1).alias("node"),
        (F.col("status") == "purged").cast("int").alias("purge"),
        none.cast("bigint").alias("seq"),
        none.cast("string").alias("root"),
    ).unionByName(
        feed.select(
            F.lit(0).alias("node"),
            F.lit(0).alias("purge"),
            "seq",
            F.col("merkle_root_hash").alias("root"),
        )
    )
    totals = rows.agg(
        F.coalesce(F.sum("node"), F.lit(0)).alias("ingested_entities"),
        F.coalesce(F.sum("purge"), F.lit(0)).alias("purged_entities"),
        F.max_by("root", "seq").alias("root"),
    )
    return totals.select(
        F.lit(num_shards).alias("active_shards"),
        "ingested_entities",
        "purged_entities",
        F.coalesce("root", F.lit("")).alias("latest_merkle_root"),
        short_hash(F.col("root"), messages.HASH_PLACEHOLDER).alias("short_root"),
    )


def active_entities(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("status") == "active").select("entity_id").distinct()
