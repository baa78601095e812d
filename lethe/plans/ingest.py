"""Ingest of request batches into the stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe import messages
from lethe.functions.annotate import rule_annotate
from lethe.operators import graph, vectors
from lethe.operators.embed import Encoder, embed_documents, hashing_encoder
from lethe.operators.shards import slot_rows, with_cell
from lethe.operators.telemetry import ingest_events
from lethe.operators.triplets import extract_triplets, triplet_rows
from lethe.operators.validate import (
    accepted,
    batch_verdicts,
    dimension_error,
    ingest_checks,
    require_numbers,
    with_empty_batches,
)
from lethe.sources.store import ShardedStore, Transaction, touched_cells


@dataclass(frozen=True)
class IngestResult:
    responses: DataFrame  # one row per stored request
    batches: DataFrame  # one row per batch
    events: DataFrame


def prepare(
    requests: DataFrame,
    store: ShardedStore,
    encoder: Encoder | None = None,
    annotator: Callable[[Column], Column] = rule_annotate,
    even: bool = False,
) -> DataFrame:
    """Accepted requests with shard, vector, triplets and the item's own error; texts are
    shuffled only if the options deal them out, and not if they are spread evenly as they are."""
    options = store.options
    encoder = encoder or hashing_encoder(options.dimension)
    if options.input_partitions and not even:
        requests = requests.repartition(options.input_partitions)
    located = with_cell(requests, options)
    encoded = embed_documents(extract_triplets(located, annotator), encoder)
    wrong = F.format_string(
        messages.STORAGE_ERROR, dimension_error(F.col("vector"), options.dimension)
    )
    error = F.coalesce(
        "message",
        F.when(dimension_error(F.col("vector"), options.dimension).isNotNull(), wrong),
    )
    return encoded.select(
        "batch_id",
        "seq",
        "id",
        "entity_id",
        "shard_id",
        "bucket",
        "vector",
        "triplets",
        error.alias("error"),
    )


def batch_summary(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """Answer per batch: rejected as a whole, failed if every item failed, else completed with
    the number of items that made it."""
    results = items.groupBy("batch_id").agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("done"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("seq", "error"))).alias("first"),
    )
    rejected = F.col("message").isNotNull()
    done = F.coalesce("done", F.lit(0))
    return verdicts.join(results, "batch_id", "left").select(
        "batch_id",
        F.when(rejected, F.lit(0)).otherwise(done).alias("total_processed"),
        F.when(rejected, F.col("status_code"))
        .when(done == 0, F.lit(500))
        .otherwise(F.lit(200))
        .alias("status_code"),
        F.when(rejected, F.col("message"))
        .when(done == 0, F.col("first.error"))
        .otherwise(F.lit(messages.INGEST_BATCH_DONE))
        .alias("status"),
    )


def ingest_responses(items: DataFrame) -> DataFrame:
    return items.where(F.col("error").isNull()).select(
        "batch_id",
        "seq",
        "id",
        "entity_id",
        "shard_id",
        F.size("triplets").alias("triplets_extracted"),
        F.lit(messages.INGESTED).alias("status"),
    )


def run_ingest_batch(
    store: ShardedStore,
    requests: DataFrame,
    as_of: int,
    encoder: Encoder | None = None,
    annotator: Callable[[Column], Column] = rule_annotate,
    source: str | None = None,
    batch: int = 0,
    batches: DataFrame | None = None,
    numbers: tuple[int, int] | None = None,
) -> IngestResult | None:
    """Validate, embed, extract and store request batches (batch_id, seq, id, entity_id, text).

    Requests apply in ``seq`` order. All tables switch in one commit, so a failed job leaves
    nothing behind. A (source, batch) that was already applied is skipped and gives None.
    ``batches`` lists all batches that arrived: one without a request is answered as empty,
    or as malformed. ``numbers`` are the sequence numbers the source gave this batch, kept for
    the next one. Responses are kept until :meth:`ShardedStore.drop_results`, or until a purge
    by another job.
    """
    store.take()
    if source is not None and batch <= store.applied(source)["batch"]:
        return None
    try:
        checks = store.stage(ingest_checks(requests))
        total, most = require_numbers(checks, F.col("task"))
        # No task reads much more than its share.
        even = most * (store.options.input_partitions or 1) <= 1.25 * total
        verdicts = batch_verdicts(checks, F.col("message"))
        if batches is not None:
            verdicts = with_empty_batches(verdicts, batches, messages.INGEST_EMPTY_BATCH)
        verdicts = store.stage(verdicts)
        items = store.stage(
            prepare(accepted(requests, verdicts), store, encoder, annotator, even)
        )
        good = items.where(F.col("error").isNull())
        change = _changes(store, good, as_of)
        change.commit(source, batch, numbers=numbers)
        responses = store.keep(ingest_responses(items), "responses")
        answers = store.keep(batch_summary(verdicts, items), "batches")
    finally:
        store.drop_staged()
    return IngestResult(responses, answers, ingest_events(responses))


def _changes(store: ShardedStore, good: DataFrame, as_of: int) -> Transaction:
    """Staged items for all tables of the store."""
    change = store.begin()

    # Vectors: the index tells which cells may hold an overwritten slot; of those only the files
    # that do are rewritten, everything else is added. A batch of new ids opens no vectors.
    slots = slot_rows(good, store.options).distinct()
    overwritten: set[str] = set()
    if store.cells("slots"):
        slots = store.stage(slots)
        known = store.read("slots", touched_cells(slots)).join(
            slots.select(*vectors.SLOT).distinct(), vectors.SLOT, "left_semi"
        )
        owners = {
            (r.shard_id, r.owner_bucket)
            for r in known.select("shard_id", "owner_bucket").distinct().collect()
        }
        if owners:
            keys = slots.select(*vectors.SLOT).distinct()
            overwritten = store.files_with({"vectors": (owners, keys)}).get("vectors", set())
            slots = slots.join(known.drop("bucket"), [*vectors.SLOT, "owner_bucket"], "left_anti")
    columns = ["id", "entity_id", "vector", "shard_id", "bucket"]
    latest = vectors.latest_per_slot(good.select(*columns, "seq")).select(*columns)
    if overwritten:
        kept = store.read_files("vectors", overwritten).join(
            good.select(*vectors.SLOT).distinct(), vectors.SLOT, "left_anti"
        )
        latest = kept.unionByName(latest)
    change.rewrite("vectors", latest, overwritten)
    change.append("slots", slots)

    # Graph: nodes that are new, every edge, and no purge mark on entities with new knowledge.
    triplets = triplet_rows(good, *vectors.OWNER, "bucket")
    cells = touched_cells(good)
    if cells & store.cells("concept"):
        known = store.read("concept", cells).drop("bucket")
        concepts = graph.new_concepts(known, triplets)
    else:  # no node to compare with: triplets are unnested once
        concepts = graph.concepts_of(triplets)
    change.append("concept", with_cell(concepts, store.options))
    now = F.timestamp_seconds(F.lit(as_of))
    change.append(
        "knowledge", with_cell(graph.knowledge_rows(triplets, now), store.options)
    )
    marked = set()
    markable = store.cells_of_any_shard("purged_from", cells)
    if markable:
        marks = store.read("purged_from", markable)
        taught = triplets.select("entity_id").distinct()
        marked = touched_cells(marks.join(taught, "entity_id", "left_semi"))
    if marked:
        change.replace(
            "purged_from",
            graph.clear_purge_marks(store.read("purged_from", marked), triplets),
            marked,
        )
    return change


def run_ingest(store: ShardedStore, requests: DataFrame, as_of: int, **options):
    """Single requests: every row is its own batch, so a bad one rejects only itself."""
    require_numbers(requests.withColumn("batch_id", F.lit("")))
    singles = requests.withColumn("batch_id", F.col("seq").cast("string"))
    return run_ingest_batch(store, singles, as_of, **options)
