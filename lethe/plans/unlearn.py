"""Erasure of entities: purge, record, certify, in that order."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe import messages
from lethe.operators import graph, vectors
from lethe.operators.certificates import issue_certificates
from lethe.operators.shards import slot_rows, with_cell
from lethe.operators.telemetry import unlearn_events
from lethe.operators.validate import (
    accepted,
    require_numbers,
    unlearn_batch_verdicts,
    unlearn_error,
    with_empty_batches,
)
from lethe.sources.store import ShardedStore, WriteFailed, touched_cells


class UnlearnFailed(RuntimeError):
    """A purge job failed; ``code`` names the step."""

    def __init__(self, code: str, cause: BaseException) -> None:
        super().__init__(f"{code}: {cause}")
        self.code = code


# Which step a table belongs to.
STEP = {
    "vectors": messages.PURGE_FAILED,
    "knowledge": messages.GRAPH_PURGE_FAILED,
    "concept": messages.GRAPH_PURGE_FAILED,
    "audit_certificates": messages.AUDIT_PERSIST_FAILED,
}


@contextmanager
def reporting():
    try:
        yield
    except WriteFailed as error:
        raise UnlearnFailed(
            STEP.get(error.table, messages.AUDIT_RECORD_FAILED), error
        ) from error


@dataclass(frozen=True)
class UnlearnResult:
    outcomes: DataFrame  # one row per request of an accepted batch
    certificates: DataFrame
    batches: DataFrame
    events: DataFrame


def unlearn_outcome(
    requests: DataFrame, in_vectors: DataFrame, in_graph: DataFrame
) -> DataFrame:
    """Adds ``status_code``, ``error`` and ``message`` to valid requests (seq, entity_id,
    shard_id): 404 if the entity is in neither store, or was already purged by an earlier
    request of the same set.

    Stores and requests are reduced to one row per entity before they meet; only the last
    join sees repeated requests, on its streamed side.
    """
    first = requests.groupBy(*vectors.OWNER).agg(F.min("seq").alias("first_seq"))
    present = (
        in_vectors.select(*vectors.OWNER).unionByName(in_graph.select(*vectors.OWNER)).distinct()
    )
    winners = first.join(present, vectors.OWNER, "left_semi")
    found = F.coalesce(F.col("seq") == F.col("first_seq"), F.lit(False))
    missing = F.format_string(messages.ENTITY_MISSING, F.col("entity_id"))
    return (
        requests.join(winners, vectors.OWNER, "left")
        .withColumn("status_code", F.when(found, F.lit(200)).otherwise(F.lit(404)))
        .withColumn("error", F.when(~found, F.lit(messages.ENTITY_NOT_FOUND)))
        .withColumn("message", F.when(found, F.lit(messages.UNLEARNED)).otherwise(missing))
        .drop("first_seq")
    )


def batch_summary(verdicts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Answer per batch, as for ingest: the first error only if no request succeeded."""
    results = outcomes.groupBy("batch_id").agg(
        F.count(F.when(F.col("status_code") == 200, 1)).alias("done"),
        F.min(
            F.when(F.col("status_code") != 200, F.struct("seq", "status_code", "message"))
        ).alias("first"),
    )
    rejected = F.col("v.message").isNotNull()
    done = F.coalesce("done", F.lit(0))
    return (
        verdicts.alias("v")
        .join(results, "batch_id", "left")
        .select(
            "batch_id",
            F.when(rejected, F.lit(0)).otherwise(done).alias("total_processed"),
            F.when(rejected, F.col("v.status_code"))
            .when(done == 0, F.col("first.status_code"))
            .otherwise(F.lit(200))
            .alias("status_code"),
            F.when(rejected, F.col("v.message"))
            .when(done == 0, F.col("first.message"))
            .otherwise(F.lit(messages.UNLEARN_BATCH_DONE))
            .alias("status"),
        )
    )


PURGED = ("vectors", "knowledge", "concept")


def _purge(store: ShardedStore, outcomes: DataFrame, cells, as_of: int, record: tuple) -> None:
    """Erase the successful requests' entities and record it, in one commit.

    An entity's cell follows from its id, so only cells of requested entities are searched, by
    their key columns; of those, only files that hold a purged entity are read whole and
    rewritten. All other files of the store are not even opened.
    """
    purged = outcomes.where(F.col("status_code") == 200).select(
        "seq", "entity_id", "shard_id", "bucket"
    )
    owners = purged.select(*vectors.OWNER).distinct()
    change = store.begin()
    files = store.files_with({table: (cells, owners) for table in PURGED})
    for table, held in files.items():
        kept = vectors.purge_vectors(store.read_files(table, held), owners)
        change.rewrite(table, kept, held)
    if "vectors" in files:
        gone = store.stage(
            slot_rows(
                vectors.entity_vectors(store.read_files("vectors", files["vectors"]), owners),
                store.options,
            )
        )
        ids = gone.select(*vectors.SLOT).distinct()
        entries = store.files_with({"slots": (touched_cells(gone), ids)}).get("slots", set())
        left = store.read_files("slots", entries).join(ids, vectors.SLOT, "left_anti")
        change.rewrite("slots", left, entries)
    if files:
        now = F.timestamp_seconds(F.lit(as_of))
        stamped = purged.withColumn("timestamp", now).withColumn("updated_at", now)
        change.append("purged_from", stamped)
        entities = graph.upsert_nodes(
            store.read("entity", cells), stamped, ["entity_id", "shard_id", "bucket"]
        )
        change.replace("entity", entities, cells)
        shards = store.read("shard").drop("bucket")
        hubs = graph.upsert_nodes(shards, stamped, ["shard_id"])
        change.replace("shard", hubs.withColumn("bucket", F.lit(0)), store.cells("shard"))
    change.append("unlearn_log", outcomes.withColumn("timestamp_epoch", F.lit(as_of)))
    source, batch, numbers = record
    with reporting():
        change.commit(source, batch, "purged", numbers)


def run_unlearn_batch(
    store: ShardedStore,
    requests: DataFrame,
    as_of: int,
    private_key: bytes,
    source: str = "unlearn",
    batch: int | None = None,
    batches: DataFrame | None = None,
    numbers: tuple[int, int] | None = None,
) -> UnlearnResult | None:
    """Purge the entities of request batches (batch_id, seq, entity_id).

    The purge is committed first. Then every copy of the purged rows is erased and seen to be
    gone: superseded files, what other jobs wrote without committing it, what they staged, and
    the responses they kept. Only then a certificate is made, so none can vouch for live data.
    A job that died in between erases and certifies on its next run what it had purged. A
    (source, batch) that is already certified is skipped and gives None; by default batches
    count upwards. ``batches`` lists all batches that arrived: one without a request is answered
    as empty, or as malformed. ``numbers`` as for ingest.
    """
    store.take()
    state = store.applied(source)
    if batch is None:
        batch = state["batch"] + (1 if state["phase"] == "done" else 0)
    if batch < state["batch"] or (batch == state["batch"] and state["phase"] == "done"):
        return None
    tag = f"{source}/{batch}"
    try:
        # Whatever requests come from is computed once.
        requests = store.stage(requests.select("batch_id", "seq", "entity_id"))
        require_numbers(requests)
        verdicts = unlearn_batch_verdicts(requests)
        if batches is not None:
            verdicts = with_empty_batches(verdicts, batches, messages.UNLEARN_EMPTY_BATCH)
        verdicts = store.keep(verdicts, "verdicts")
        if batch != state["batch"]:
            located = with_cell(accepted(requests, verdicts), store.options)
            wanted = store.stage(
                located.select("batch_id", "seq", "entity_id", "shard_id", "bucket")
            )
            cells = touched_cells(wanted)
            done = store.stage(
                unlearn_outcome(
                    wanted, store.read("vectors", cells), store.read("concept", cells)
                ).withColumn("request_source", F.lit(tag))
            )
            _purge(store, done, cells, as_of, (source, batch, numbers))
            done = done.withColumn("timestamp_epoch", F.lit(as_of).cast("long"))
        else:
            done = store.read("unlearn_log").where(F.col("request_source") == tag)

        store.sweep(results=True)
        purges = done.where(F.col("status_code") == 200).select(
            "entity_id", "shard_id", "bucket", "timestamp_epoch", "seq"
        )
        try:
            signed = store.stage(with_cell(issue_certificates(purges, private_key), store.options))
        except Exception as error:
            raise UnlearnFailed(messages.AUDIT_PERSIST_FAILED, error) from error
        change = store.begin()
        change.append("audit_certificates", signed)
        with reporting():
            change.commit(source, batch, "done", numbers)
        certificates = store.keep(signed.drop("bucket"), "certificates")
        outcomes = store.keep(done.drop("bucket", "request_source"), "outcomes")
    finally:
        store.drop_staged()
    return UnlearnResult(
        outcomes, certificates, batch_summary(verdicts, outcomes), unlearn_events(certificates)
    )


def single_answers(requests: DataFrame, batches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Answers to single requests: with an error code, and without the id in the message of a
    bad one."""
    bad = unlearn_error(F.col("entity_id")).isNotNull()
    asked = requests.select(F.col("seq").cast("string").alias("batch_id"), bad.alias("bad"))
    errors = outcomes.select("batch_id", "error")
    return (
        batches.join(asked, "batch_id", "left")
        .join(errors, "batch_id", "left")
        .select(
            "batch_id",
            "total_processed",
            "status_code",
            F.when(F.col("bad"), F.lit(messages.UNLEARN_INVALID))
            .when(F.col("status_code") == 200, F.lit(messages.UNLEARNED))
            .otherwise(F.col("status"))
            .alias("status"),
            F.when(F.col("bad"), F.lit(messages.INVALID_INPUT)).otherwise(F.col("error")).alias("error"),
        )
    )


def run_unlearn(store: ShardedStore, requests: DataFrame, as_of: int, private_key: bytes, **o):
    """Single requests: every row is its own batch, and is answered as one."""
    require_numbers(requests.withColumn("batch_id", F.lit("")))
    singles = requests.withColumn("batch_id", F.col("seq").cast("string"))
    result = run_unlearn_batch(store, singles, as_of, private_key, **o)
    if result is None:
        return None
    return replace(result, batches=single_answers(requests, result.batches, result.outcomes))
