"""Fixed schemas of every table the engine keeps or exchanges."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INGEST_PAYLOAD = _struct(id=_S, entity_id=_S, text=_S)
INGEST_REQUEST = _struct(batch_id=_S, seq=_L, ts=_TS, id=_S, entity_id=_S, text=_S)
UNLEARN_PAYLOAD = _struct(entity_id=_S)
UNLEARN_REQUEST = _struct(batch_id=_S, seq=_L, ts=_TS, entity_id=_S)
REQUEST_LOG = _struct(seq=_L, op=_S, entity_id=_S, id=_S, shard_id=_I, n_triplets=_I)

TOKEN = _struct(tok_id=_I, text=_S, lemma=_S, pos=_S, dep=_S)
TOKEN_TABLE = _struct(doc_id=_S, sent_id=_I, tok_id=_I, text=_S, lemma=_S, pos=_S, dep=_S)
TRIPLET = _struct(subject=_S, predicate=_S, object=_S)

VECTORS = _struct(id=_S, entity_id=_S, vector=T.ArrayType(T.FloatType()), shard_id=_I)
CONCEPT = _struct(concept_id=_S, name=_S, entity_id=_S, shard_id=_I)
KNOWLEDGE = _struct(
    sub_id=_S, obj_id=_S, predicate=_S, shard_id=_I, entity_id=_S, timestamp=_TS
)
ENTITY = _struct(entity_id=_S, updated_at=_TS, shard_id=_I)
SHARD = _struct(shard_id=_I, updated_at=_TS)
PURGED_FROM = _struct(entity_id=_S, shard_id=_I, timestamp=_TS)
CERTIFICATE = _struct(
    audit_id=_S,
    entity_id=_S,
    shard_id=_I,
    merkle_root_hash=_S,
    signature=_S,
    timestamp_epoch=_L,
    status=_S,
)
LEDGER = T.StructType([*CERTIFICATE.fields, T.StructField("seq", _L)])
UNLEARN_LOG = _struct(
    batch_id=_S,
    seq=_L,
    entity_id=_S,
    shard_id=_I,
    status_code=_I,
    error=_S,
    message=_S,
    timestamp_epoch=_L,
    request_source=_S,
)
# Which cell of its shard the vector of an id lies in; laid out by a hash of the id.
SLOTS = _struct(id=_S, owner_bucket=_I, shard_id=_I)
EVENT = _struct(
    seq=_L,
    ord=_I,
    type=_S,
    payload=_struct(id=_S, entity_id=_S, shard_id=_I, audit_certificate=CERTIFICATE),
)

# Tables kept by the store. All of them are laid out by (shard_id, bucket).
STORED = {
    "vectors": VECTORS,
    "slots": SLOTS,
    "concept": CONCEPT,
    "knowledge": KNOWLEDGE,
    "entity": ENTITY,
    "shard": SHARD,
    "purged_from": PURGED_FROM,
    "audit_certificates": LEDGER,
    "unlearn_log": UNLEARN_LOG,
}
