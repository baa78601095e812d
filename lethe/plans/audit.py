"""Audits over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lethe.operators.certificates import (
    PAIR,
    audit_ledger,
    audit_verdict,
    latest_certificate,
    verify_certificates,
)
from lethe.operators.shards import with_cell
from lethe.sources.store import Cell, ShardedStore, touched_cells


def _past(store: ShardedStore, table: str, cells: set[Cell] | None):
    """Rows that keep the shard a purge happened on."""
    wanted = None if cells is None else store.cells_of_any_shard(table, cells)
    return store.read(table, wanted)


def _tables(store: ShardedStore, cells: set[Cell] | None = None) -> dict:
    return {
        "entity": store.read("entity", cells),
        "marks": _past(store, "purged_from", cells),
        "shard": store.read("shard"),
        "vectors": store.read("vectors", cells),
        "concept": store.read("concept", cells),
        "num_shards": store.options.num_shards,
    }


def audit_requests(store: ShardedStore, requests: DataFrame, public_key: bytes) -> DataFrame:
    """Verdict per request (entity_id, shard_id).

    Everything about an entity lies in the cell its id gives, so only those cells are read. A
    reading error fails the job; it never counts as "nothing left".
    """
    cells = touched_cells(with_cell(requests.select("entity_id"), store.options))
    ledger = _past(store, "audit_certificates", cells).drop("bucket")
    asked = ledger.join(requests.select(*PAIR).distinct(), PAIR, "left_semi")
    certificates = verify_certificates(latest_certificate(asked), public_key)
    return audit_verdict(requests, certificates=certificates, **_tables(store, cells))


def audit_store(store: ShardedStore, public_key: bytes) -> DataFrame:
    """Verdict for every (entity, shard) pair of the whole ledger."""
    ledger = store.read("audit_certificates").drop("bucket")
    return audit_ledger(ledger, public_key, **_tables(store))
