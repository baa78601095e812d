"""Whole request pipelines: on the store, and replayed from a log."""

from __future__ import annotations

from contextlib import suppress
from dataclasses import replace

from pyspark.sql import functions as F

from lethe import messages
from lethe.catalog import query
from lethe.catalog.certificates import PUBLIC_KEY
from lethe.catalog.inputs import (
    DEMO_KEY,
    DIMENSION,
    ENTITIES,
    EPOCH,
    LEDGER,
    REQ,
    SHARDS,
    TOXIC,
    VEC,
    document_requests,
    request_log,
    sharded,
    sql_log,
    sql_shard,
    sql_text,
    stored_vectors,
    table,
    text_of,
    toxic_entities,
    unsigned_ledger,
    user,
)
from lethe.catalog.requests import (
    _BATCHED,
    _batched,
    _sql_ingest_error,
    ingest_lines,
    unlearn_lines,
)
from lethe.catalog.triplets import sql_triplets
from lethe.operators.shards import with_cell
from lethe.operators.validate import accepted, unlearn_batch_verdicts
from lethe.options import EngineOptions
from lethe.plans.audit import audit_requests, audit_store
from lethe.plans.ingest import run_ingest, run_ingest_batch
from lethe.plans.replay import replay_request_log
from lethe.plans.unlearn import batch_summary, run_unlearn, run_unlearn_batch, unlearn_outcome
from lethe.session import materialise, new_dir
from lethe.sources.export import export_ledger_array, export_ledger_lines
from lethe.sources.requests import (
    read_ingest_documents,
    read_ingest_payloads,
    read_unlearn_documents,
    read_unlearn_payloads,
)
from lethe.sources.store import ShardedStore, touched_cells

OPTIONS = EngineOptions(num_shards=SHARDS, dimension=DIMENSION, buckets=4)


def new_store(spark) -> ShardedStore:
    cores = spark.sparkContext.defaultParallelism  # the given files are single
    options = replace(OPTIONS, input_partitions=cores)
    return ShardedStore(spark, new_dir(spark, "store"), options)


# Batch algebra.


def _asked(spark, sf_dir):
    """One unlearn request per label; a third of the entities was never stored."""
    return sharded(
        table(spark, sf_dir, "labels").select(
            text_of("b_", F.expr("doc_id div 20")).alias("batch_id"),
            F.col("doc_id").alias("seq"),
            text_of("user_", F.col("doc_id") % 151).alias("entity_id"),
        )
    )


def _in_graph(spark, sf_dir):
    return sharded(
        table(spark, sf_dir, "conversations").select(
            text_of("user_", F.col("conv_id") % 120).alias("entity_id")
        )
    )


_MISSING = " || entity_id || ".join(sql_text(p) for p in messages.ENTITY_MISSING.split("%s"))

_OUTCOMES = f"""{VEC},
asked AS (SELECT *, {sql_shard("entity_id")} AS shard_id FROM (
  SELECT 'b_' || (doc_id // 20) AS batch_id, doc_id AS seq,
         'user_' || (doc_id % 151) AS entity_id FROM labels)),
here AS (SELECT entity_id FROM vec
         UNION SELECT 'user_' || (conv_id % 120) FROM conversations),
judged AS (
  SELECT *, entity_id IN (SELECT entity_id FROM here)
            AND seq = min(seq) OVER (PARTITION BY entity_id) AS ok FROM asked),
outcome AS (
  SELECT batch_id, seq, entity_id, shard_id, CASE WHEN ok THEN 200 ELSE 404 END AS status_code,
         CASE WHEN NOT ok THEN '{messages.ENTITY_NOT_FOUND}' END AS error,
         CASE WHEN ok THEN '{messages.UNLEARNED}' ELSE {_MISSING} END AS message
  FROM judged)"""


def _outcomes(spark, sf_dir):
    return unlearn_outcome(
        _asked(spark, sf_dir), stored_vectors(spark, sf_dir), _in_graph(spark, sf_dir)
    )


@query(
    "unlearn_outcome",
    f"""WITH {_OUTCOMES} SELECT seq, entity_id, shard_id, status_code, error, message
        FROM outcome""",
)
def outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select(
        "seq", "entity_id", "shard_id", "status_code", "error", "message"
    )


@query(
    "unlearn_batch_summary",
    f"""WITH {_OUTCOMES}
        SELECT batch_id, count(*) FILTER (status_code = 200) AS total_processed,
          CASE WHEN count(*) FILTER (status_code = 200) > 0 THEN 200 ELSE 404 END AS status_code,
          CASE WHEN count(*) FILTER (status_code = 200) > 0
               THEN '{messages.UNLEARN_BATCH_DONE}' ELSE arg_min(message, seq) END AS status
        FROM outcome GROUP BY batch_id""",
)
def unlearn_summary(spark, sf_dir):
    requests = _asked(spark, sf_dir)
    verdicts = unlearn_batch_verdicts(requests)
    kept = accepted(requests, verdicts)
    judged = unlearn_outcome(kept, stored_vectors(spark, sf_dir), _in_graph(spark, sf_dir))
    return batch_summary(verdicts, judged)


# Store pipelines.


@query(
    "run_ingest_batch",
    f"""WITH {_BATCHED}, checked AS (
          SELECT *, {_sql_ingest_error("id", "entity_id", "text")} AS message FROM batched),
        bad AS (SELECT batch_id, arg_min(message, seq) AS message FROM checked
                WHERE message IS NOT NULL GROUP BY batch_id)
        SELECT batch_id, CASE WHEN message IS NULL THEN size ELSE 0 END AS total_processed,
          CASE WHEN message IS NULL THEN 200 ELSE 400 END AS status_code,
          coalesce(message, '{messages.INGEST_BATCH_DONE}') AS status
        FROM (SELECT batch_id, count(*) AS size FROM batched GROUP BY batch_id)
        LEFT JOIN bad USING (batch_id)""",
)
def ingest_batches(spark, sf_dir):
    """Batches of documents, some with pages among them, stored; the answer per batch."""
    return run_ingest_batch(new_store(spark), _batched(spark, sf_dir), EPOCH).batches


@query(
    "run_ingest",
    f"""WITH {REQ}, {sql_triplets("documents")}
        SELECT seq, id, entity_id, {sql_shard("entity_id")} AS shard_id,
               CAST(count(n) AS INTEGER) AS triplets_extracted,
               '{messages.INGESTED}' AS status
        FROM req LEFT JOIN trip ON trip.doc_id = req.seq GROUP BY ALL""",
)
def ingest_responses(spark, sf_dir):
    result = run_ingest(new_store(spark), document_requests(spark, sf_dir), EPOCH)
    return result.responses.drop("batch_id")


@query(
    "run_ingest_singles",
    f"""WITH req AS (SELECT doc_id AS seq, 'doc_' || doc_id AS id,
          CASE WHEN source = 'src1' THEN '!' ELSE 'user_' || (doc_id % {ENTITIES}) END AS entity_id
        FROM documents)
        SELECT CAST(seq AS VARCHAR) AS batch_id, CASE WHEN entity_id = '!' THEN 0 ELSE 1 END AS total_processed,
          CASE WHEN entity_id = '!' THEN 400 ELSE 200 END AS status_code,
          CASE WHEN entity_id = '!' THEN {sql_text(messages.INGEST_INVALID)}
               ELSE '{messages.INGEST_BATCH_DONE}' END AS status
        FROM req""",
)
def ingest_singles(spark, sf_dir):
    """Documents as single requests, those of one source with a bad owner: each fails alone."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        text_of("doc_", F.col("doc_id")).alias("id"),
        F.when(F.col("source") == "src1", F.lit("!")).otherwise(user(F.col("doc_id"))).alias("entity_id"),
        "text",
    )
    return run_ingest(new_store(spark), docs, EPOCH).batches


@query(
    "ingest_from_json_files",
    f"""SELECT 'turn_' || conv_id || '_' || turn AS id, 'conv_' || conv_id AS entity_id
        FROM conversations
        UNION ALL
        SELECT 'copy_' || conv_id || '_' || turn, 'conv_' || conv_id
        FROM conversations WHERE role <> 'user'""",
)
def ingest_from_json_files(spark, sf_dir):
    """Payload files through the reader and the job into the store, with nothing rejected."""
    store = new_store(spark)
    found = read_ingest_payloads(spark, ingest_lines(spark, sf_dir))
    run_ingest_batch(store, found.requests, EPOCH, batches=found.batches)
    return store.read("vectors").select("id", "entity_id")


_ASKED_LINES = f"""lines AS (SELECT doc_id, toxic, 'user_' || (doc_id % {ENTITIES}) AS entity_id FROM labels)"""


@query(
    "unlearn_from_json_files",
    f"""WITH {_ASKED_LINES}
        SELECT entity_id, CAST(count(*) AS BIGINT) AS asked, CAST(1 AS BIGINT) AS purged
        FROM lines GROUP BY entity_id
        UNION ALL SELECT 'owner_' || doc_id, 1, 0 FROM lines WHERE toxic = 0""",
)
def unlearn_from_json_files(spark, sf_dir):
    """Objects and bare arrays from files: every stored entity is purged once, all else is 404."""
    store = new_store(spark)
    run_ingest_batch(store, document_requests(spark, sf_dir), EPOCH)
    found = read_unlearn_payloads(spark, unlearn_lines(spark, sf_dir))
    result = run_unlearn_batch(
        store, found.requests, EPOCH + 60, DEMO_KEY, batches=found.batches
    )
    return result.outcomes.groupBy("entity_id").agg(
        F.count("*").alias("asked"), F.count_if(F.col("status_code") == 200).alias("purged")
    )


@query(
    "malformed_payloads",
    f"""SELECT CASE WHEN role = 'user' THEN 400 ELSE 200 END AS status_code,
          CASE WHEN role = 'user' THEN {sql_text(messages.PAYLOAD_MALFORMED)}
               ELSE '{messages.INGEST_BATCH_DONE}' END AS status, count(*) AS n
        FROM conversations GROUP BY ALL""",
)
def malformed_payloads(spark, sf_dir):
    """User turns cut off in the middle of their JSON are answered, the others are stored."""
    request = F.to_json(
        F.struct(
            F.concat_ws("_", F.lit("turn"), F.col("conv_id"), F.col("turn")).alias("id"),
            text_of("conv_", F.col("conv_id")).alias("entity_id"),
            "text",
        )
    )
    cut = F.substring(request, F.lit(1), F.length(request) - 1)
    path = new_dir(spark, "payloads")
    lines = table(spark, sf_dir, "conversations").select(
        F.when(F.col("role") == "user", cut).otherwise(request)
    )
    lines.write.text(path)
    found = read_ingest_payloads(spark, path)
    result = run_ingest_batch(new_store(spark), found.requests, EPOCH, batches=found.batches)
    return result.batches.groupBy("status_code", "status").agg(F.count("*").alias("n"))


@query(
    "empty_batches",
    f"""SELECT CASE WHEN toxic = 1 THEN {sql_text(messages.UNLEARN_EMPTY_BATCH)}
               ELSE replace({sql_text(messages.ENTITY_MISSING)}, '%s', 'ghost_' || doc_id) END AS status,
          CASE WHEN toxic = 1 THEN 400 ELSE 404 END AS status_code
        FROM labels""",
)
def empty_batches(spark, sf_dir):
    """Empty arrays, one for each toxic label, are answered like any other bad batch."""
    path = new_dir(spark, "payloads")
    table(spark, sf_dir, "labels").select(
        F.when(F.col("toxic") == 1, F.lit("[]")).otherwise(
            F.to_json(F.array(text_of("ghost_", F.col("doc_id"))))
        )
    ).write.text(path)
    found = read_unlearn_payloads(spark, path)
    store = new_store(spark)
    result = run_unlearn_batch(store, found.requests, EPOCH, DEMO_KEY, batches=found.batches)
    return result.batches.select("status", "status_code")


@query(
    "ingest_into_filled_store",
    f"WITH {REQ} SELECT id, entity_id, {sql_shard('entity_id')} AS shard_id, 1 AS n FROM req",
)
def ingest_into_filled_store(spark, sf_dir):
    """All documents twice: the second load overwrites every slot of the first."""
    store = new_store(spark)
    for as_of in (EPOCH, EPOCH + 60):
        run_ingest_batch(store, document_requests(spark, sf_dir), as_of)
    keys = ["id", "entity_id", "shard_id"]
    return store.read("vectors").groupBy(*keys).agg(F.count("*").cast("int").alias("n"))


class _DiesAfterTheSwitch(ShardedStore):
    def erase(self) -> None:
        raise RuntimeError("died before the deletion")


@query(
    "unlearn_after_crash",
    f"WITH {TOXIC} SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS rows_on_disk, true AS certified FROM toxic",
)
def unlearn_after_crash(spark, sf_dir):
    """A job dies between purge and deletion, a second one goes on: rows of the purged entities
    in any file below the store, referred to or not, and whether a certificate exists."""
    store = new_store(spark)
    run_ingest_batch(store, document_requests(spark, sf_dir), EPOCH)
    requests = toxic_entities(spark, sf_dir).select("batch_id", "seq", "entity_id")
    dying = _DiesAfterTheSwitch(spark, store.root, store.options)
    with suppress(RuntimeError):
        run_unlearn_batch(dying, requests, EPOCH + 60, DEMO_KEY, source="s", batch=0)
    store.refresh()
    run_unlearn_batch(store, requests, EPOCH + 60, DEMO_KEY, source="s", batch=0)
    on_disk = _rows_below(spark, store.root, ("vectors", "concept", "knowledge"))
    counts = on_disk.groupBy("entity_id").agg(F.count("*").alias("rows_on_disk"))
    certified = store.read("audit_certificates").select("entity_id").distinct()
    return (
        requests.select("entity_id")
        .distinct()
        .join(counts, "entity_id", "left")
        .join(certified.withColumn("certified", F.lit(True)), "entity_id", "left")
        .select(
            "entity_id",
            F.coalesce("rows_on_disk", F.lit(0)).alias("rows_on_disk"),
            F.coalesce("certified", F.lit(False)).alias("certified"),
        )
    )


class _DiesBeforeTheSwitch(ShardedStore):
    def _publish(self, manifest) -> None:
        if manifest is not self.manifest:  # a commit, not the taking of the store
            raise RuntimeError("died before the switch")
        super()._publish(manifest)


def _rows_below(spark, path, tables=("",)):
    """Rows per entity in all files below some folders, whether anything refers to them or not."""
    reader = spark.read.option("recursiveFileLookup", "true").schema("entity_id string")
    return reader.parquet(*[f"{path}/{t}" for t in tables])


@query(
    "unlearn_leaves_no_copy",
    f"""WITH lines AS (SELECT DISTINCT 'conv_' || conv_id AS entity_id FROM conversations)
        SELECT entity_id, CAST(0 AS BIGINT) AS rows_on_disk, true AS certified FROM lines""",
)
def unlearn_leaves_no_copy(spark, sf_dir):
    """Payload files are ingested, a second job of the same entities dies before its switch, then
    all of them are purged: rows of each in any file of the store, and whether it is certified."""
    store = new_store(spark)
    found = read_ingest_payloads(spark, ingest_lines(spark, sf_dir))
    run_ingest_batch(store, found.requests, EPOCH, source="one", batches=found.batches)
    dying = _DiesBeforeTheSwitch(spark, store.root, store.options)
    with suppress(RuntimeError):
        run_ingest_batch(dying, found.requests, EPOCH, source="two", batches=found.batches)
    entities = materialise(
        found.requests.groupBy("entity_id").agg(F.min("seq").alias("seq")), "entities"
    )
    requests = entities.select(F.lit("b").alias("batch_id"), "seq", "entity_id")
    run_unlearn_batch(store, requests, EPOCH + 60, DEMO_KEY)
    held = [t for t in ("vectors", "slots", "concept", "knowledge", "_staging") if store.has(t)]
    counts = (
        _rows_below(spark, store.root, held).groupBy("entity_id").agg(F.count("*").alias("n"))
        if held
        else spark.createDataFrame([], "entity_id string, n long")
    )
    certified = store.read("audit_certificates").select("entity_id").distinct()
    return (
        entities.select("entity_id")
        .join(counts, "entity_id", "left")
        .join(certified.withColumn("certified", F.lit(True)), "entity_id", "left")
        .select(
            "entity_id",
            F.coalesce("n", F.lit(0)).alias("rows_on_disk"),
            F.coalesce("certified", F.lit(False)).alias("certified"),
        )
    )


def _documents(spark, payloads, per_file) -> str:
    """A folder with one pretty-printed JSON array per group of rows."""
    pretty = payloads.groupBy(per_file.alias("file")).agg(
        F.to_json(F.sort_array(F.collect_list("request")), {"pretty": "true"}).alias("value")
    )
    path = new_dir(spark, "documents")
    # A partition per file, as the text writer starts a new file for each.
    pretty.write.partitionBy("file").text(path)
    return path


@query(
    "ingest_from_documents",
    """SELECT 'turn_' || conv_id || '_' || turn AS id, 'conv_' || conv_id AS entity_id
       FROM conversations""",
)
def ingest_from_documents(spark, sf_dir):
    """Files that hold one pretty-printed array each, of all turns of some conversations."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.struct(
            F.concat_ws("_", F.lit("turn"), F.col("conv_id"), F.col("turn")).alias("id"),
            text_of("conv_", F.col("conv_id")).alias("entity_id"),
            "text",
        ).alias("request"),
    )
    store = new_store(spark)
    found = read_ingest_documents(spark, _documents(spark, turns, F.col("conv_id") % 16))
    run_ingest_batch(store, found.requests, EPOCH, batches=found.batches)
    return store.read("vectors").select("id", "entity_id")


@query(
    "unlearn_from_documents",
    f"""WITH asked AS (SELECT 'user_' || (doc_id % {ENTITIES}) AS entity_id FROM labels),
        held AS (SELECT 'user_' || (doc_id % {ENTITIES}) AS entity_id FROM documents)
        SELECT entity_id, count(*) AS asked,
          CAST(CASE WHEN entity_id IN (SELECT entity_id FROM held) THEN 1 ELSE 0 END AS BIGINT) AS purged
        FROM asked GROUP BY entity_id""",
)
def unlearn_from_documents(spark, sf_dir):
    """Pretty-printed arrays of ids, one per file: each stored entity is purged once."""
    store = new_store(spark)
    run_ingest_batch(store, document_requests(spark, sf_dir), EPOCH)
    asked = table(spark, sf_dir, "labels").select("doc_id", user(F.col("doc_id")).alias("request"))
    found = read_unlearn_documents(spark, _documents(spark, asked, F.col("doc_id") % 8))
    result = run_unlearn_batch(store, found.requests, EPOCH + 60, DEMO_KEY, batches=found.batches)
    return result.outcomes.groupBy("entity_id").agg(
        F.count("*").alias("asked"), F.count_if(F.col("status_code") == 200).alias("purged")
    )


def _vector_store(spark, sf_dir) -> ShardedStore:
    """A store holding the embeddings."""
    store = new_store(spark)
    change = store.begin()
    change.append("vectors", with_cell(stored_vectors(spark, sf_dir), OPTIONS))
    change.commit()
    return store


@query(
    "store_scan",
    f"""WITH {VEC}, {TOXIC} SELECT id, entity_id, shard_id FROM vec
        WHERE entity_id IN (SELECT entity_id FROM toxic)""",
)
def store_scan(spark, sf_dir):
    """Stored vectors of the toxic entities, read from their cells only."""
    store = _vector_store(spark, sf_dir)
    wanted = with_cell(toxic_entities(spark, sf_dir), OPTIONS)
    rows = store.read("vectors", touched_cells(wanted))
    keys = ["shard_id", "entity_id"]
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi").select(
        "id", "entity_id", "shard_id"
    )


@query(
    "store_missing_shard",
    f"""WITH {VEC} SELECT CAST(s.range AS INTEGER) AS shard_id, count(v.id) AS n
        FROM range({SHARDS}) s LEFT JOIN vec v ON v.shard_id = s.range AND s.range % 2 = 0
        GROUP BY s.range""",
)
def store_missing_shard(spark, sf_dir):
    """Whole shards erased: their cells have no files and read as empty."""
    store = _vector_store(spark, sf_dir)
    odd = {cell for cell in store.cells("vectors") if cell[0] % 2 == 1}
    change = store.begin()
    change.replace("vectors", store.read("vectors", odd).where(F.lit(False)), odd)
    change.commit()
    counts = store.read("vectors").groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    hubs = spark.range(SHARDS).select(F.col("id").cast("int").alias("shard_id"))
    return hubs.join(counts, "shard_id", "left").fillna(0, ["n"])


def unlearned_store(spark, sf_dir) -> ShardedStore:
    """All documents ingested, then the toxic owners unlearned."""
    store = new_store(spark)
    run_ingest_batch(store, document_requests(spark, sf_dir), EPOCH)
    requests = toxic_entities(spark, sf_dir).select("batch_id", "seq", "entity_id")
    run_unlearn_batch(store, requests, EPOCH + 60, DEMO_KEY)
    return store


@query(
    "run_unlearn_singles",
    f"""WITH {REQ}, asked AS (
          SELECT doc_id AS seq, CASE WHEN doc_id % 7 = 0 THEN '!' ELSE 'user_' || (doc_id % 131) END AS entity_id
          FROM labels),
        judged AS (SELECT *, entity_id IN (SELECT entity_id FROM req)
                   AND seq = min(seq) OVER (PARTITION BY entity_id) AS ok FROM asked)
        SELECT CAST(seq AS VARCHAR) AS batch_id, CASE WHEN ok THEN 1 ELSE 0 END AS total_processed,
          CASE WHEN entity_id = '!' THEN 400 WHEN ok THEN 200 ELSE 404 END AS status_code,
          CASE WHEN entity_id = '!' THEN {sql_text(messages.UNLEARN_INVALID)}
               WHEN ok THEN '{messages.UNLEARNED}' ELSE {_MISSING} END AS status,
          CASE WHEN entity_id = '!' THEN '{messages.INVALID_INPUT}'
               WHEN NOT ok THEN '{messages.ENTITY_NOT_FOUND}' END AS error
        FROM judged""",
)
def unlearn_singles(spark, sf_dir):
    """One single request per label, some with a bad id: each is answered as one."""
    store = new_store(spark)
    run_ingest_batch(store, document_requests(spark, sf_dir), EPOCH)
    asked = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("!"))
        .otherwise(text_of("user_", F.col("doc_id") % 131))
        .alias("entity_id"),
    )
    return run_unlearn(store, asked, EPOCH + 60, DEMO_KEY).batches


@query(
    "run_unlearn",
    f"""WITH {REQ}, {TOXIC}, {sql_triplets("documents")},
        kept AS (SELECT *, {sql_shard("entity_id")} AS shard_id FROM req
                 WHERE entity_id NOT IN (SELECT entity_id FROM toxic)),
        edges AS (SELECT k.entity_id, k.shard_id, t.* FROM kept k
                  JOIN trip t ON t.doc_id = k.seq)
        SELECT 'vectors' AS part, shard_id, count(*) AS n FROM kept GROUP BY shard_id
        UNION ALL SELECT 'knowledge', shard_id, count(*) FROM edges GROUP BY shard_id
        UNION ALL SELECT 'concept', shard_id, count(*) FROM (
          SELECT DISTINCT entity_id, shard_id, name FROM (
            SELECT entity_id, shard_id, subject AS name FROM edges
            UNION ALL SELECT entity_id, shard_id, object FROM edges)) GROUP BY shard_id
        UNION ALL SELECT 'purged_from', shard_id, count(DISTINCT entity_id) FROM toxic
          WHERE entity_id IN (SELECT entity_id FROM req) GROUP BY shard_id
        UNION ALL SELECT 'audit_certificates', shard_id, count(DISTINCT entity_id) FROM toxic
          WHERE entity_id IN (SELECT entity_id FROM req) GROUP BY shard_id""",
)
def unlearn_state(spark, sf_dir):
    """Row counts per stored table and shard after the purge, each label a request by itself."""
    store = new_store(spark)
    run_ingest(store, document_requests(spark, sf_dir), EPOCH)
    run_unlearn(store, toxic_entities(spark, sf_dir).select("seq", "entity_id"), EPOCH + 60, DEMO_KEY)
    result = None
    for name in ("vectors", "knowledge", "concept", "purged_from", "audit_certificates"):
        part = (
            store.read(name)
            .groupBy("shard_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("part"), "shard_id", "n")
        )
        result = part if result is None else result.unionByName(part)
    return result


_FIRST = f"""{REQ}, {TOXIC},
done AS (SELECT entity_id, shard_id, min(seq) AS seq FROM toxic
         WHERE entity_id IN (SELECT entity_id FROM req) GROUP BY ALL),
hashed AS (SELECT *, sha256(entity_id || ':' || shard_id || ':' || {EPOCH + 60}) AS h
           FROM done)"""

_VALID = sql_text(messages.AUDIT_VALID).replace("%s", "' || entity_id || '").replace(
    "%d", "' || shard_id || '"
)


@query(
    "unlearn_and_audit",
    f"""WITH {_FIRST}
        SELECT 'audit_' || shard_id || '_{EPOCH + 60}_' || substr(h, 1, 8) || '_' || seq
                 AS audit_id, entity_id, shard_id, h AS merkle_root_hash,
               true AS is_valid, {_VALID} AS message FROM hashed""",
)
def unlearn_and_audit(spark, sf_dir):
    """Ingest every document, unlearn the toxic owners, audit the whole ledger."""
    store = unlearned_store(spark, sf_dir)
    return audit_store(store, PUBLIC_KEY).select(
        "audit_id", "entity_id", "shard_id", "merkle_root_hash", "is_valid", "message"
    )


@query(
    "audit_requests",
    f"""WITH {_FIRST}, asked AS (
          SELECT DISTINCT 'user_' || (doc_id % {ENTITIES}) AS entity_id FROM documents)
        SELECT entity_id, {sql_shard("entity_id")} AS shard_id,
               entity_id IN (SELECT entity_id FROM done) AS is_valid,
               CASE WHEN entity_id IN (SELECT entity_id FROM done) THEN '{messages.CERTIFIED}'
                    ELSE '{messages.UNVERIFIED}' END AS status
        FROM asked""",
)
def audit_every_owner(spark, sf_dir):
    """The same store, asked about every owner, purged or not."""
    store = unlearned_store(spark, sf_dir)
    asked = sharded(
        table(spark, sf_dir, "documents")
        .select(user(F.col("doc_id")).alias("entity_id"))
        .distinct()
    )
    return audit_requests(store, asked, PUBLIC_KEY).select(
        "entity_id", "shard_id", "is_valid", "status"
    )


@query("append_certificates", f"WITH {LEDGER} SELECT * FROM ledger")
def append_certificates(spark, sf_dir):
    """The ledger appended in two commits and read back."""
    store = new_store(spark)
    ledger = with_cell(unsigned_ledger(spark, sf_dir), OPTIONS)
    for rest in (0, 1):
        change = store.begin()
        change.append("audit_certificates", ledger.where(F.col("seq") % 2 == rest))
        change.commit()
    return store.read("audit_certificates").drop("bucket")


@query(
    "export_ledger_lines",
    f"""WITH {LEDGER} SELECT audit_id, entity_id, shard_id, merkle_root_hash, timestamp_epoch,
        status FROM ledger""",
)
def ledger_lines(spark, sf_dir):
    path = new_dir(spark, "ledger")
    ledger = unsigned_ledger(spark, sf_dir)
    export_ledger_lines(ledger, path)
    return spark.read.schema(ledger.schema).json(path).select(
        "audit_id", "entity_id", "shard_id", "merkle_root_hash", "timestamp_epoch", "status"
    )


_LINE = f"""'{{"audit_id":"' || audit_id || '","entity_id":"' || entity_id ||
  '","shard_id":' || shard_id || ',"merkle_root_hash":"' || merkle_root_hash ||
  '","signature":"","timestamp_epoch":' || timestamp_epoch ||
  ',"status":"{messages.CERTIFIED}"}}'"""


@query(
    "export_ledger_array",
    f"""WITH {LEDGER} SELECT '[' AS value UNION ALL SELECT ']' UNION ALL
        SELECT CASE WHEN audit_id = (SELECT min(audit_id) FROM ledger) THEN '' ELSE ',' END ||
               {_LINE} FROM ledger""",
)
def ledger_array(spark, sf_dir):
    path = new_dir(spark, "ledger")
    export_ledger_array(unsigned_ledger(spark, sf_dir), path)
    return spark.read.text(path)


# Replay of a mixed request log.


def sql_replay(shared_ids: bool) -> str:
    return f"""{sql_log(shared_ids)},
ing AS (
  SELECT *, lead(seq) OVER (PARTITION BY shard_id, id ORDER BY seq) AS overwritten
  FROM log WHERE op = 'I'),
att AS (SELECT seq, entity_id, shard_id FROM log WHERE op = 'U'),
timeline AS (
  SELECT i.*, a.seq AS attempt FROM ing i
  ASOF LEFT JOIN att a ON a.entity_id = i.entity_id AND a.seq > i.seq),
won AS (
  SELECT DISTINCT entity_id, shard_id, attempt AS seq FROM timeline
  WHERE attempt IS NOT NULL
    AND (n_triplets > 0 OR overwritten IS NULL OR overwritten > attempt))"""


@query(
    "replay_final_vectors",
    f"""WITH {sql_replay(True)} SELECT id, entity_id, shard_id, seq FROM timeline
        WHERE overwritten IS NULL AND attempt IS NULL""",
)
def replay_vectors(spark, sf_dir):
    return replay_request_log(request_log(spark, sf_dir, True)).vectors


@query(
    "replay_final_vectors_unique_ids",
    f"""WITH {sql_replay(False)} SELECT id, entity_id, shard_id, seq FROM timeline
        WHERE overwritten IS NULL AND attempt IS NULL""",
)
def replay_unique(spark, sf_dir):
    return replay_request_log(request_log(spark, sf_dir, False)).vectors


@query(
    "replay_unlearn_outcomes",
    f"""WITH {sql_replay(True)} SELECT seq, entity_id, shard_id,
          CASE WHEN ok THEN 200 ELSE 404 END AS status_code,
          CASE WHEN ok THEN '{messages.UNLEARNED}' ELSE {_MISSING} END AS message
        FROM (SELECT *, (entity_id, seq) IN (SELECT (entity_id, seq) FROM won) AS ok
              FROM att)""",
)
def replay_outcomes(spark, sf_dir):
    return replay_request_log(request_log(spark, sf_dir, True)).outcomes


@query(
    "replay_purge_marks",
    f"""WITH {sql_replay(True)} SELECT entity_id, shard_id, seq FROM won
        WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.entity_id = won.entity_id
                          AND l.op = 'I' AND l.n_triplets > 0 AND l.seq > won.seq)""",
)
def replay_marks(spark, sf_dir):
    return replay_request_log(request_log(spark, sf_dir, True)).marks


@query(
    "replay_graph",
    f"""WITH {sql_replay(True)} SELECT entity_id, shard_id, CAST(sum(n_triplets) AS BIGINT)
          AS edges FROM timeline WHERE attempt IS NULL AND n_triplets > 0 GROUP BY ALL""",
)
def replay_graph(spark, sf_dir):
    return replay_request_log(request_log(spark, sf_dir, True)).graph
