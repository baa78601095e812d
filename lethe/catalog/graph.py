"""Property graph queries: documents are stored, benchmark passages arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.catalog import query
from lethe.catalog.inputs import (
    ENTITIES,
    EPOCH,
    TOXIC,
    benchmark_triplets,
    document_triplets,
    sharded,
    sql_shard,
    table,
    text_of,
    toxic_entities,
    user,
)
from lethe.catalog.triplets import sql_triplets
from lethe.operators import graph
from lethe.session import materialise

_STORED = f"""{sql_triplets("documents")},
stored AS (SELECT *, {sql_shard("entity_id")} AS shard_id FROM (
  SELECT *, 'user_' || (doc_id % {ENTITIES}) AS entity_id FROM trip))"""

_ARRIVED = f"""bench AS (SELECT item_id AS doc_id, text FROM benchmark),
{sql_triplets("bench", "b_")},
arrived AS (SELECT *, {sql_shard("entity_id")} AS shard_id FROM (
  SELECT *, 'user_' || (doc_id % {ENTITIES}) AS entity_id FROM b_trip))"""


def _sql_concepts(relation: str) -> str:
    return f"""SELECT DISTINCT entity_id || ':' || name AS concept_id, name, entity_id, shard_id
      FROM (SELECT entity_id, shard_id, subject AS name FROM {relation}
            UNION ALL SELECT entity_id, shard_id, object FROM {relation})"""


@query(
    "upsert_concepts",
    f"""WITH {_STORED}, {_ARRIVED}
        {_sql_concepts("stored")} UNION {_sql_concepts("arrived")}""",
)
def upsert_concepts(spark, sf_dir):
    base = materialise(graph.concepts_of(document_triplets(spark, sf_dir)))
    return graph.upsert_concepts(base, benchmark_triplets(spark, sf_dir))


_EDGE = f"""entity_id || ':' || subject AS sub_id, entity_id || ':' || object AS obj_id,
  predicate, shard_id, entity_id, {EPOCH}::BIGINT AS timestamp"""


def _now():
    return F.timestamp_seconds(F.lit(EPOCH))


def _epochs(df):
    """Timestamps shown as epoch seconds, free of any time zone."""
    return df.withColumn("timestamp", F.unix_timestamp("timestamp"))


@query(
    "append_knowledge",
    f"""WITH {_STORED}, {_ARRIVED} SELECT {_EDGE} FROM stored
        UNION ALL SELECT {_EDGE} FROM arrived""",
)
def append_knowledge(spark, sf_dir):
    base = graph.knowledge_rows(document_triplets(spark, sf_dir), _now())
    return _epochs(graph.append_knowledge(base, benchmark_triplets(spark, sf_dir), _now()))


def _marks(spark, sf_dir):
    """A purge mark per label."""
    return sharded(
        table(spark, sf_dir, "labels").select(
            user(F.col("doc_id")).alias("entity_id"),
            F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id")).alias("timestamp"),
        )
    ).select("entity_id", "shard_id", "timestamp")


_MARKS = f"""marks AS (
  SELECT entity_id, {sql_shard("entity_id")} AS shard_id, timestamp FROM (
    SELECT 'user_' || (doc_id % {ENTITIES}) AS entity_id,
           ({EPOCH} + doc_id)::BIGINT AS timestamp FROM labels))"""


@query(
    "clear_purge_marks",
    f"""WITH {_MARKS}, {_ARRIVED} SELECT entity_id, shard_id, timestamp FROM marks
        WHERE entity_id NOT IN (SELECT entity_id FROM arrived)""",
)
def clear_purge_marks(spark, sf_dir):
    return _epochs(
        graph.clear_purge_marks(_marks(spark, sf_dir), benchmark_triplets(spark, sf_dir))
    )


@query(
    "purge_subgraph",
    f"""WITH {_STORED}, {TOXIC},
        kept AS (SELECT * FROM stored WHERE entity_id NOT IN (SELECT entity_id FROM toxic)),
        con AS ({_sql_concepts("kept")})
        SELECT 'knowledge' AS part, entity_id, shard_id, count(*) AS n FROM kept GROUP BY ALL
        UNION ALL
        SELECT 'concept', entity_id, shard_id, count(*) FROM con GROUP BY ALL""",
)
def purge_subgraph(spark, sf_dir):
    rows = materialise(document_triplets(spark, sf_dir))
    knowledge, concept = graph.purge_subgraph(
        graph.knowledge_rows(rows, _now()),
        graph.concepts_of(rows),
        toxic_entities(spark, sf_dir),
    )

    def counted(df, part):
        return df.groupBy("entity_id", "shard_id").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(part).alias("part"), "entity_id", "shard_id", "n"
        )

    return counted(knowledge, "knowledge").unionByName(counted(concept, "concept"))


def _recorded(spark, sf_dir):
    """Stored nodes and marks from good-quality labels; the toxic entities are recorded."""
    labels = table(spark, sf_dir, "labels")
    stored = sharded(
        labels.where(F.col("quality") == 1).select(
            user(F.col("doc_id")).alias("entity_id"),
            F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id")).alias("timestamp"),
        )
    )
    entity = stored.groupBy("entity_id", "shard_id").agg(
        F.max("timestamp").alias("updated_at")
    )
    shard = stored.groupBy("shard_id").agg(F.max("timestamp").alias("updated_at"))
    marks = stored.select("entity_id", "shard_id", "timestamp")
    purges = toxic_entities(spark, sf_dir).withColumn(
        "timestamp", F.timestamp_seconds(F.lit(EPOCH) - F.col("seq"))
    )
    return graph.record_purge(entity, shard, marks, purges)


_RECORDED = f"""{TOXIC},
kept AS (
  SELECT entity_id, {sql_shard("entity_id")} AS shard_id, ts FROM (
    SELECT 'user_' || (doc_id % {ENTITIES}) AS entity_id,
           ({EPOCH} + doc_id)::BIGINT AS ts FROM labels WHERE quality = 1)),
added AS (SELECT entity_id, shard_id, ({EPOCH} - seq)::BIGINT AS ts
          FROM toxic)"""


@query(
    "record_purge",
    f"""WITH {_RECORDED}
        SELECT 'entity' AS part, k AS key, ts FROM (
          SELECT coalesce(a.entity_id, k.entity_id) AS k, coalesce(a.ts, k.ts) AS ts
          FROM (SELECT entity_id, max(ts) AS ts FROM kept GROUP BY ALL) k
          FULL JOIN (SELECT entity_id, max(ts) AS ts FROM added GROUP BY ALL) a
            ON a.entity_id = k.entity_id)
        UNION ALL
        SELECT 'shard', k, ts FROM (
          SELECT coalesce(a.shard_id, k.shard_id)::VARCHAR AS k, coalesce(a.ts, k.ts) AS ts
          FROM (SELECT shard_id, max(ts) AS ts FROM kept GROUP BY ALL) k
          FULL JOIN (SELECT shard_id, max(ts) AS ts FROM added GROUP BY ALL) a
            ON a.shard_id = k.shard_id)
        UNION ALL SELECT 'purged_from', entity_id || '/' || shard_id, ts FROM kept
        UNION ALL SELECT 'purged_from', entity_id || '/' || shard_id, ts FROM added""",
)
def record_purge(spark, sf_dir):
    entity, shard, marks = _recorded(spark, sf_dir)
    relation = F.concat_ws("/", "entity_id", F.col("shard_id").cast("string"))
    return (
        entity.select(
            F.lit("entity").alias("part"),
            F.col("entity_id").alias("key"),
            F.unix_timestamp("updated_at").alias("ts"),
        )
        .unionByName(
            shard.select(
                F.lit("shard").alias("part"),
                F.col("shard_id").cast("string").alias("key"),
                F.unix_timestamp("updated_at").alias("ts"),
            )
        )
        .unionByName(
            marks.select(
                F.lit("purged_from").alias("part"),
                relation.alias("key"),
                F.unix_timestamp("timestamp").alias("ts"),
            )
        )
    )


@query(
    "affected_shards",
    f"""WITH {_RECORDED} SELECT entity_id, shard_id FROM kept
        UNION ALL SELECT entity_id, shard_id FROM added""",
)
def affected_shards(spark, sf_dir):
    entity, shard, marks = _recorded(spark, sf_dir)
    return graph.affected_shards(entity, marks, shard)


@query(
    "entity_in_graph",
    f"""WITH {_STORED} SELECT doc_id AS seq, e AS entity_id, {sql_shard("e")} AS shard_id,
               e IN (SELECT entity_id FROM stored) AS in_graph
        FROM (SELECT *, 'user_' || (doc_id % 131) AS e FROM labels)""",
)
def entity_in_graph(spark, sf_dir):
    asked = sharded(
        table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("seq"),
            text_of("user_", F.col("doc_id") % 131).alias("entity_id"),
        )
    )
    concept = graph.concepts_of(document_triplets(spark, sf_dir))
    return graph.entity_in_graph(asked, concept).select(
        "seq", "entity_id", "shard_id", "in_graph"
    )


@query(
    "concept_isolation",
    f"""WITH {_STORED}, {TOXIC}, con AS ({_sql_concepts("stored")})
        SELECT entity_id, count(*) AS n_before,
          CASE WHEN entity_id IN (SELECT entity_id FROM toxic) THEN 0 ELSE count(*) END
            AS n_after,
          entity_id IN (SELECT entity_id FROM toxic) AS purged, true AS isolated
        FROM con GROUP BY entity_id
        UNION ALL
        SELECT DISTINCT entity_id, 0, 0, true, true FROM toxic
        WHERE entity_id NOT IN (SELECT entity_id FROM con)""",
)
def concept_isolation(spark, sf_dir):
    gone = toxic_entities(spark, sf_dir)
    rows = materialise(document_triplets(spark, sf_dir))
    before = graph.concepts_of(rows)
    _, after = graph.purge_subgraph(graph.knowledge_rows(rows, _now()), before, gone)
    report = graph.concept_isolation(before, after, gone)
    absent = gone.select("entity_id").distinct().join(report, "entity_id", "left_anti")
    zero = F.lit(0).cast("bigint")
    return report.unionByName(
        absent.select(
            "entity_id",
            zero.alias("n_before"),
            zero.alias("n_after"),
            F.lit(True).alias("purged"),
            F.lit(True).alias("isolated"),
        )
    )


