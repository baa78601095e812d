"""Purge certificates and the audit that checks them against the stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe import messages, schemas
from lethe.functions.ed25519 import sign_column, verify_column
from lethe.functions.hashing import assign_shard, audit_id, certificate_hash
from lethe.functions.text import valid_identifier
from lethe.operators.graph import affected_shards
from lethe.operators.vectors import present_entities

PAIR = ["entity_id", "shard_id"]
_FIELDS = schemas.CERTIFICATE.fieldNames()


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """One partition per core for work that costs per row and not per byte (signatures).

    The keys must be unique per row, or nearly so, for the rows to spread evenly.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def unsigned_certificates(purges: DataFrame) -> DataFrame:
    """Certificates but for the signature, from (entity_id, shard_id, timestamp_epoch, seq).

    The number closing an audit id is the request's own ``seq``: unique in the ledger, the
    same on every retry, and known without counting rows across tasks.
    """
    shard, epoch = F.col("shard_id"), F.col("timestamp_epoch")
    hashed = purges.withColumn(
        "merkle_root_hash", certificate_hash(F.col("entity_id"), shard, epoch)
    )
    return hashed.withColumn(
        "audit_id", audit_id(shard, epoch, F.col("merkle_root_hash"), F.col("seq"))
    ).withColumn("status", F.lit(messages.CERTIFIED))


def issue_certificates(purges: DataFrame, private_key: bytes) -> DataFrame:
    """Signed certificates; the signature covers the 64 hex characters of the hash."""
    unsigned = unsigned_certificates(spread_by(purges, "seq"))
    signed = unsigned.withColumn(
        "signature", sign_column(F.col("merkle_root_hash"), private_key)
    )
    return signed.select(*_FIELDS, "seq")


def verify_hash(certificates: DataFrame) -> DataFrame:
    """Adds ``hash_valid``: is the stored hash that of the certificate's own fields?"""
    expected = certificate_hash(
        F.col("entity_id"), F.col("shard_id"), F.col("timestamp_epoch")
    )
    valid = F.coalesce(F.col("merkle_root_hash") == expected, F.lit(False))
    return certificates.withColumn("hash_valid", valid)


def verify_certificates(certificates: DataFrame, public_key: bytes) -> DataFrame:
    """Adds ``hash_valid``, ``signature_valid`` and ``cert_valid``.

    Signatures are the costly part: rows are spread over all cores, and a row whose hash
    already failed sends null to the check.
    """
    hashed = verify_hash(spread_by(certificates, "audit_id"))
    message = F.when(F.col("hash_valid"), F.col("merkle_root_hash"))
    return hashed.withColumn(
        "signature_valid", verify_column(message, F.col("signature"), public_key)
    ).withColumn("cert_valid", F.col("hash_valid") & F.col("signature_valid"))


def latest_certificate(ledger: DataFrame) -> DataFrame:
    """Newest certificate per (entity, shard); within one second the higher ``seq`` wins."""
    return (
        ledger.groupBy(*PAIR)
        .agg(
            F.max_by(
                F.struct(*[c for c in ledger.columns if c not in PAIR]),
                F.struct("timestamp_epoch", "seq"),
            ).alias("c")
        )
        .select(*PAIR, "c.*")
    )


def verdict_message(
    is_valid: Column, related: Column, active: Column, entity_id: Column, shard_id: Column
) -> Column:
    """First reason in fixed order: valid, no purge relation, still active, bad certificate."""
    return (
        F.when(is_valid, F.format_string(messages.AUDIT_VALID, entity_id, shard_id))
        .when(~related, F.format_string(messages.AUDIT_NO_RELATION, entity_id, shard_id))
        .when(active, F.format_string(messages.AUDIT_STILL_ACTIVE, entity_id))
        .otherwise(F.format_string(messages.AUDIT_BAD_CERTIFICATE, entity_id, shard_id))
    )


def placeholder_fields() -> dict[str, Column]:
    """Certificate fields shown where the ledger holds none for the pair."""
    return {
        "audit_id": F.concat_ws(
            "_", F.lit("unverified"), F.col("shard_id").cast("string"), F.col("entity_id")
        ),
        "merkle_root_hash": F.lit(""),
        "signature": F.lit(""),
        "timestamp_epoch": F.lit(0).cast("bigint"),
        "status": F.lit(messages.UNVERIFIED),
    }


def audit_pairs(
    pairs: DataFrame,
    *,
    entity: DataFrame,
    marks: DataFrame,
    shard: DataFrame,
    vectors: DataFrame,
    concept: DataFrame,
    certificates: DataFrame,
    num_shards: int,
) -> DataFrame:
    """Verdict for distinct (entity, shard) pairs.

    ``certificates`` holds the newest certificate per pair with ``cert_valid``. Whatever is
    joined on was reduced to one row per key first, with map-side combining, so no join here
    has a repeated key on either side.
    """
    related = affected_shards(entity, marks, shard).distinct()

    def active(table: DataFrame, flag: str) -> DataFrame:
        owned = present_entities(table).withColumnRenamed("shard_id", "home_shard")
        return owned.withColumn(flag, F.lit(True))

    joined = (
        pairs.withColumn("home_shard", assign_shard(F.col("entity_id"), num_shards))
        .join(active(vectors, "in_vectors"), ["home_shard", "entity_id"], "left")
        .join(active(concept, "in_graph"), ["home_shard", "entity_id"], "left")
        .join(related.withColumn("related", F.lit(True)), PAIR, "left")
        .join(certificates.select(*PAIR, *placeholder_fields(), "cert_valid"), PAIR, "left")
    )
    for flag in ("in_vectors", "in_graph", "related", "cert_valid"):
        joined = joined.withColumn(flag, F.coalesce(flag, F.lit(False)))
    in_use = F.col("in_vectors") | F.col("in_graph")
    judged = joined.withColumn("is_valid", F.col("related") & ~in_use & F.col("cert_valid"))
    for name, default in placeholder_fields().items():
        judged = judged.withColumn(name, F.coalesce(F.col(name), default))
    message = verdict_message(
        F.col("is_valid"),
        F.col("related"),
        in_use,
        F.col("entity_id"),
        F.col("shard_id"),
    )
    return judged.withColumn("message", message).drop("home_shard")


def audit_verdict(requests: DataFrame, **stores) -> DataFrame:
    """One verdict per request (entity_id, shard_id). Ids that are no identifiers get status 400.

    Each distinct pair is judged once, then joined back, so repeats of one pair are cheap.
    """
    valid = valid_identifier(F.col("entity_id"))
    pairs = requests.where(valid).select(*PAIR).distinct()
    judged = audit_pairs(pairs, **stores)
    answered = requests.join(judged, PAIR, "left")
    return answered.withColumn(
        "status_code", F.when(valid, F.lit(200)).otherwise(F.lit(400))
    ).withColumn(
        "message", F.when(valid, F.col("message")).otherwise(F.lit(messages.UNLEARN_INVALID))
    )


def audit_ledger(ledger: DataFrame, public_key: bytes, **stores) -> DataFrame:
    """Verdict for every pair of the ledger at once."""
    newest = latest_certificate(ledger)
    certificates = verify_certificates(newest, public_key)
    return audit_pairs(newest.select(*PAIR), certificates=certificates, **stores)


def proof_label(is_valid: Column) -> Column:
    """Label of the proof view; an audit that could not be made counts as invalid."""
    return F.when(
        F.coalesce(is_valid, F.lit(False)), F.lit(messages.PROOF_RECORDED)
    ).otherwise(F.lit(messages.PROOF_MISSING))
