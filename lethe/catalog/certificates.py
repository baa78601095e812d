"""Certificate and audit queries over a ledger with one certificate per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe import messages
from lethe.catalog import query
from lethe.catalog.inputs import (
    DEMO_KEY,
    LEDGER,
    SHARDS,
    TOXIC,
    VEC,
    purges,
    sharded,
    sql_shard,
    sql_text,
    stored_vectors,
    table,
    text_of,
    toxic_entities,
    unsigned_ledger,
    user,
)
from lethe.functions import ed25519
from lethe.functions.hashing import certificate_hash
from lethe.operators import certificates
from lethe.operators.vectors import purge_vectors

PUBLIC_KEY = ed25519.public_key(DEMO_KEY)


def signed_ledger(spark, sf_dir):
    return certificates.issue_certificates(
        purges(spark, sf_dir).select("entity_id", "shard_id", "timestamp_epoch", "seq"), DEMO_KEY
    )


@query(
    "certificate_hash",
    f"WITH {LEDGER} SELECT seq, entity_id, merkle_root_hash FROM ledger",
)
def hashes(spark, sf_dir):
    return purges(spark, sf_dir).select(
        "seq",
        "entity_id",
        certificate_hash(
            F.col("entity_id"), F.col("shard_id"), F.col("timestamp_epoch")
        ).alias("merkle_root_hash"),
    )


@query("audit_id", f"WITH {LEDGER} SELECT seq, audit_id FROM ledger")
def audit_ids(spark, sf_dir):
    return unsigned_ledger(spark, sf_dir).select("seq", "audit_id")


@query(
    "issue_certificates",
    f"""WITH {LEDGER} SELECT audit_id, entity_id, shard_id, merkle_root_hash, timestamp_epoch,
        status, 128 AS signature_length FROM ledger""",
)
def issue(spark, sf_dir):
    return signed_ledger(spark, sf_dir).select(
        "audit_id",
        "entity_id",
        "shard_id",
        "merkle_root_hash",
        "timestamp_epoch",
        "status",
        F.length("signature").alias("signature_length"),
    )


@query(
    "verify_signature",
    f"""WITH {LEDGER} SELECT audit_id, true AS hash_valid, true AS signature_valid,
        true AS cert_valid FROM ledger""",
)
def verify(spark, sf_dir):
    return certificates.verify_certificates(signed_ledger(spark, sf_dir), PUBLIC_KEY).select(
        "audit_id", "hash_valid", "signature_valid", "cert_valid"
    )


# Which field of a certificate is changed, by its sequence number.
_TAMPER = ["none", "entity_id", "shard_id", "timestamp_epoch", "hash", "signature", "status"]


def _near_miss(signature, seq):
    """The signature with one hex digit changed: of its point, or of the lowest byte of its
    scalar, which stays below the group order, so that only the curve equation can tell."""

    def flipped(at):
        digit = F.translate(
            F.substring(signature, at, 1), "0123456789abcdef", "123456789abcdef0"
        )
        return F.overlay(signature, digit, at, 1)

    return F.when(seq % 2 == 0, flipped(1)).otherwise(flipped(65))


@query(
    "verify_hash",
    f"""WITH {LEDGER} SELECT seq, change, change IN ('none', 'signature', 'status') AS hash_valid
        FROM (SELECT *, {_TAMPER}[(seq % {len(_TAMPER)} + 1)::INTEGER] AS change
              FROM ledger)""",
)
def verify_hashes(spark, sf_dir):
    return certificates.verify_hash(_tampered(unsigned_ledger(spark, sf_dir))).select(
        "seq", "change", "hash_valid"
    )


def _tampered(ledger):
    change = F.element_at(
        F.array(*[F.lit(c) for c in _TAMPER]), (F.col("seq") % len(_TAMPER) + 1).cast("int")
    )

    def changed(name, value, kind=None):
        return F.when(F.col("change") == (kind or name), value).otherwise(F.col(name))

    return ledger.withColumn("change", change).select(
        "seq",
        "change",
        "audit_id",
        changed("entity_id", F.concat("entity_id", F.lit("x"))).alias("entity_id"),
        changed("shard_id", F.col("shard_id") + 1).alias("shard_id"),
        changed("timestamp_epoch", F.col("timestamp_epoch") + 1).alias("timestamp_epoch"),
        changed("merkle_root_hash", F.lit("0" * 64), "hash").alias("merkle_root_hash"),
        changed("signature", _near_miss(F.col("signature"), F.col("seq"))).alias("signature"),
        changed("status", F.lit("EDITED")).alias("status"),
    )


@query(
    "tamper_detection",
    f"""WITH {LEDGER} SELECT seq, change, change IN ('none', 'status') AS cert_valid
        FROM (SELECT *, {_TAMPER}[(seq % {len(_TAMPER)} + 1)::INTEGER] AS change
              FROM ledger)""",
)
def tamper(spark, sf_dir):
    """Every seventh certificate stays whole, the others have one field changed; the status is
    not covered by the hash."""
    return certificates.verify_certificates(
        _tampered(signed_ledger(spark, sf_dir)), PUBLIC_KEY
    ).select("seq", "change", "cert_valid")


_LATEST = f"""{LEDGER}, latest AS (
  SELECT * FROM ledger QUALIFY row_number() OVER (
    PARTITION BY entity_id, shard_id ORDER BY timestamp_epoch DESC, seq DESC) = 1)"""


@query(
    "latest_certificate",
    f"""WITH {_LATEST} SELECT entity_id, shard_id, audit_id, merkle_root_hash, timestamp_epoch,
        status, seq FROM latest""",
)
def latest(spark, sf_dir):
    return certificates.latest_certificate(unsigned_ledger(spark, sf_dir)).select(
        "entity_id",
        "shard_id",
        "audit_id",
        "merkle_root_hash",
        "timestamp_epoch",
        "status",
        "seq",
    )


def _stores(spark, sf_dir):
    """Stores with every kind of verdict in them.

    Vectors of the toxic entities are gone, the graph still knows the conversations' and the
    first pages' owners, and good-quality labels left purge marks.
    """
    vectors = purge_vectors(
        stored_vectors(spark, sf_dir), toxic_entities(spark, sf_dir)
    )
    concept = sharded(
        table(spark, sf_dir, "conversations")
        .select(user(F.col("conv_id") * 5).alias("entity_id"))
        .distinct()
    )
    marks = (
        purges(spark, sf_dir).where(F.col("quality") == 1).select("entity_id", "shard_id")
    )
    return {
        "entity": marks.select("entity_id").distinct(),
        "marks": marks,
        "shard": spark.range(SHARDS).select(F.col("id").cast("int").alias("shard_id")),
        "vectors": vectors,
        "concept": concept,
        "num_shards": SHARDS,
    }


# Toxic owners are no longer in the vectors; labels with odd numbers have forged signatures.
_STORES = f"""{VEC}, {TOXIC},
live AS (SELECT entity_id FROM vec WHERE entity_id NOT IN (SELECT entity_id FROM toxic)),
known AS (SELECT DISTINCT 'user_' || (conv_id * 5 % 97) AS entity_id FROM conversations),
related AS (SELECT DISTINCT entity_id, shard_id FROM purge WHERE quality = 1)"""


def _sql_verdict(asked: str) -> str:
    """Verdict columns of a relation (entity_id, shard_id) given the CTEs above and ``cert``."""

    def fill(template: str) -> str:
        """A message template as SQL: entity first, shard second."""
        out, names = sql_text(template), ["entity_id", "shard_id"]
        for mark, name in zip(("%s", "%d"), names, strict=True):
            out = out.replace(mark, f"' || {name} || '")
        return out

    return f"""
      SELECT entity_id, shard_id, coalesce(audit_id, 'unverified_' || shard_id || '_' ||
               entity_id) AS audit_id, coalesce(merkle_root_hash, '') AS merkle_root_hash,
             coalesce(timestamp_epoch, 0) AS timestamp_epoch,
             coalesce(status, '{messages.UNVERIFIED}') AS status, in_vectors, in_graph,
             rel AS related, ok AS cert_valid,
             rel AND ok AND NOT in_vectors AND NOT in_graph AS is_valid,
             CASE WHEN rel AND ok AND NOT in_vectors AND NOT in_graph
                    THEN {fill(messages.AUDIT_VALID)}
                  WHEN NOT rel THEN {fill(messages.AUDIT_NO_RELATION)}
                  WHEN in_vectors OR in_graph THEN {fill(messages.AUDIT_STILL_ACTIVE)}
                  ELSE {fill(messages.AUDIT_BAD_CERTIFICATE)} END AS message
      FROM (SELECT a.entity_id, a.shard_id, c.audit_id, c.merkle_root_hash, c.timestamp_epoch,
                   c.status, a.entity_id IN (SELECT entity_id FROM live) AS in_vectors,
                   a.entity_id IN (SELECT entity_id FROM known) AS in_graph,
                   (a.entity_id, a.shard_id) IN (SELECT (entity_id, shard_id) FROM related)
                     AS rel, coalesce(c.valid, false) AS ok
            FROM {asked} a LEFT JOIN cert c
              ON c.entity_id = a.entity_id AND c.shard_id = a.shard_id)"""


_VERDICT = [
    "entity_id",
    "shard_id",
    "audit_id",
    "merkle_root_hash",
    "timestamp_epoch",
    "status",
    "in_vectors",
    "in_graph",
    "related",
    "cert_valid",
    "is_valid",
    "message",
]


def _with_forgeries(ledger):
    # The sequence numbers of these are odd, so the digit is chosen by their half.
    forged = F.when(
        F.col("seq") % 4 == 1, _near_miss(F.col("signature"), F.floor(F.col("seq") / 4))
    ).otherwise(F.col("signature"))
    return ledger.withColumn("signature", forged)


_CERT = "cert AS (SELECT *, seq % 4 <> 1 AS valid FROM latest)"


@query(
    "audit_ledger",
    f"""WITH {_LATEST}, {_STORES}, {_CERT}, asked AS (SELECT entity_id, shard_id FROM latest)
        {_sql_verdict("asked")}""",
)
def audit_ledger(spark, sf_dir):
    ledger = _with_forgeries(signed_ledger(spark, sf_dir))
    return certificates.audit_ledger(ledger, PUBLIC_KEY, **_stores(spark, sf_dir)).select(
        *_VERDICT
    )


_ASKED = f"""asked0 AS (
  SELECT doc_id AS seq, 'user_' || (doc_id % 131) AS entity_id,
         CAST({sql_shard("'user_' || (doc_id % 131)")} + (doc_id % 5 = 0)::INTEGER AS INTEGER)
           AS shard_id
  FROM documents
  UNION ALL SELECT -1 - page_id, url, 0 FROM pages)"""


@query(
    "audit_verdict",
    f"""WITH {_LATEST}, {_STORES}, {_CERT}, {_ASKED},
        asked AS (SELECT DISTINCT entity_id, shard_id FROM asked0
                  WHERE regexp_full_match(entity_id, '[a-zA-Z0-9_-]{{3,64}}')),
        v AS ({_sql_verdict("asked")})
        SELECT a.seq, a.entity_id, a.shard_id, audit_id, is_valid,
          CASE WHEN v.entity_id IS NULL THEN {sql_text(messages.UNLEARN_INVALID)}
               ELSE message END AS message,
          CASE WHEN v.entity_id IS NULL THEN 400 ELSE 200 END AS status_code
        FROM asked0 a LEFT JOIN v ON v.entity_id = a.entity_id AND v.shard_id = a.shard_id""",
)
def audit_verdict(spark, sf_dir):
    """Requests for known and unknown entities, some naming the wrong shard, some no id."""
    docs = sharded(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("seq"),
            text_of("user_", F.col("doc_id") % 131).alias("entity_id"),
        )
    ).withColumn("shard_id", F.col("shard_id") + (F.col("seq") % 5 == 0).cast("int"))
    pages = table(spark, sf_dir, "pages").select(
        (-1 - F.col("page_id")).alias("seq"),
        F.col("url").alias("entity_id"),
        F.lit(0).alias("shard_id"),
    )
    newest = certificates.latest_certificate(_with_forgeries(signed_ledger(spark, sf_dir)))
    checked = certificates.verify_certificates(newest, PUBLIC_KEY)
    return certificates.audit_verdict(
        docs.unionByName(pages), certificates=checked, **_stores(spark, sf_dir)
    ).select("seq", "entity_id", "shard_id", "audit_id", "is_valid", "message", "status_code")


