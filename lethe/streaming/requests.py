"""Request streams: every micro-batch runs the batch job against the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lethe.plans.ingest import run_ingest_batch
from lethe.plans.unlearn import run_unlearn_batch
from lethe.sources.requests import ingest_payloads, unlearn_payloads
from lethe.sources.store import ShardedStore


def stream_ingest(
    requests: DataFrame,
    store: ShardedStore,
    name: str,
    clock: Callable[[int], int],
    on_events: Callable[[DataFrame], None] | None = None,
    compact_every: int = 32,
    **options,
) -> DataStreamWriter:
    """Ingest a request stream; start the returned writer with a checkpoint and a trigger.

    The commit records ``name`` and the micro-batch id, so a replayed micro-batch is skipped.
    ``name`` belongs to one checkpoint. ``clock`` gives the epoch second of a micro-batch.
    ``on_events`` may write the batch's events on before its results are dropped. Each
    ``compact_every`` micro-batches, cells in many pieces are rewritten, which bounds their
    files and the manifest. A stream of payloads (:func:`stream_payloads`) is numbered on from
    the last number of the micro-batch before, which the store keeps.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        store.take()
        if batch % compact_every == compact_every - 1:
            store.compact()
        numbers = store.numbers(name, batch)
        requests, batches, end = _numbered(rows, numbers, ingest_payloads)
        result = run_ingest_batch(
            store,
            requests,
            clock(batch),
            source=name,
            batch=batch,
            batches=batches,
            numbers=(numbers, end),
            **options,
        )
        _hand_over(store, result, on_events)

    return requests.writeStream.queryName(name).foreachBatch(apply)


def stream_unlearn(
    requests: DataFrame,
    store: ShardedStore,
    name: str,
    clock: Callable[[int], int],
    private_key: bytes,
    on_events: Callable[[DataFrame], None] | None = None,
) -> DataStreamWriter:
    """Unlearn a request stream. As :func:`stream_ingest`; a micro-batch that died after its
    purge is certified when it is replayed."""

    def apply(rows: DataFrame, batch: int) -> None:
        store.take()
        numbers = store.numbers(name, batch)
        requests, batches, end = _numbered(rows, numbers, unlearn_payloads)
        result = run_unlearn_batch(
            store,
            requests,
            clock(batch),
            private_key,
            source=name,
            batch=batch,
            batches=batches,
            numbers=(numbers, end),
        )
        _hand_over(store, result, on_events)

    return requests.writeStream.queryName(name).foreachBatch(apply)


def _numbered(rows: DataFrame, first: int, parse) -> tuple[DataFrame, DataFrame | None, int]:
    """Requests, their batches, and the next free number; request tables are taken as they are."""
    if "payload" not in rows.columns:
        return rows, None, first
    found = parse(rows, first_seq=first)
    return found.requests, found.batches, found.end


def _hand_over(store: ShardedStore, result, on_events) -> None:
    if result is not None and on_events is not None:
        on_events(result.events)
    store.drop_results()
