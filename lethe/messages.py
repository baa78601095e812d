"""Status codes, error codes and texts clients match on."""

# Fixed values, compared literally by callers.
INGEST_BLANK = "Request payload 'text' and 'entity_id' cannot be empty."
INGEST_INVALID = (
    "Invalid 'id' or 'entity_id'. Must be 3-64 characters (alphanumeric, '_', '-')."
)
INGEST_EMPTY_BATCH = "Batch payload cannot be empty."
PAYLOAD_MALFORMED = "Request payload is not valid JSON of the expected form."
UNLEARN_INVALID = "Invalid 'entity_id'. Must be 3-64 characters (alphanumeric, '_', '-')."
UNLEARN_INVALID_ITEM = (
    "Invalid 'entity_id' '%s'. Must be 3-64 characters (alphanumeric, '_', '-')."
)
UNLEARN_EMPTY_BATCH = "Batch unlearn payload cannot be empty."
ENTITY_MISSING = "Entity '%s' does not exist in graph or vector storage."
EMBED_BLANK = "Input text cannot be empty."
EMBED_BLANK_BATCH = "Batch input texts cannot contain empty strings."
DIMENSION_MISMATCH = "Vector dimension mismatch: expected %d, got %d"

STORAGE_ERROR = "LanceDB storage error: %s"

AUDIT_VALID = (
    "Merkle root hash, Ed25519 signature, and SurrealDB audit relation successfully verified "
    "for entity '%s' on shard %d"
)
AUDIT_NO_RELATION = "Entity '%s' has no recorded purge relation on shard %d in SurrealDB"
AUDIT_STILL_ACTIVE = "Entity '%s' still has active data in storage and is not fully purged"
AUDIT_BAD_CERTIFICATE = (
    "Missing or cryptographically invalid audit certificate for entity '%s' on shard %d"
)

INGESTED = "SUCCESSFULLY_INGESTED"
INGEST_BATCH_DONE = "BATCH_COMPLETED"
UNLEARNED = "PURGED_AND_VERIFIED"
UNLEARN_BATCH_DONE = "BATCH_UNLEARN_COMPLETED"
CERTIFIED = "VERIFIED_PURGED"
UNVERIFIED = "UNVERIFIED"

INVALID_INPUT = "INVALID_INPUT"
ENTITY_NOT_FOUND = "ENTITY_NOT_FOUND"
PURGE_FAILED = "PURGE_FAILED"
GRAPH_PURGE_FAILED = "GRAPH_PURGE_FAILED"
AUDIT_RECORD_FAILED = "AUDIT_RECORD_FAILED"
AUDIT_PERSIST_FAILED = "AUDIT_PERSIST_FAILED"

ASSOCIATED_WITH = "ASSOCIATED_WITH"
PROOF_RECORDED = "RECORDED_PURGED_RELATION"
PROOF_MISSING = "UNVERIFIED_OR_MISSING"
HASH_PLACEHOLDER = "0x00000000...00000000"
