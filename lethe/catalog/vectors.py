"""Vector table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.catalog import query
from lethe.catalog.inputs import (
    SHARDS,
    TOXIC,
    VEC,
    sharded,
    sql_shard,
    stored_vectors,
    table,
    text_of,
    toxic_entities,
)
from lethe.operators import vectors

# A batch that overwrites the even stored ids for other entities, two writes to each id.
_NEW = f"""fresh AS (
  SELECT *, {sql_shard("entity_id")} AS shard_id FROM (
    SELECT 'vec_' || (vec_id - vec_id % 2) AS id, 'user_' || (vec_id % 89) AS entity_id,
           embedding AS vector, vec_id AS seq FROM embeddings)),
latest AS (
  SELECT * FROM fresh
  QUALIFY row_number() OVER (PARTITION BY shard_id, id ORDER BY seq DESC) = 1),
merged AS (
  SELECT id, entity_id, vector, shard_id FROM vec
  WHERE (shard_id, id) NOT IN (SELECT (shard_id, id) FROM latest)
  UNION ALL SELECT id, entity_id, vector, shard_id FROM latest)"""


def _fresh(spark, sf_dir):
    return sharded(
        table(spark, sf_dir, "embeddings").select(
            text_of("vec_", F.col("vec_id") - F.col("vec_id") % 2).alias("id"),
            text_of("user_", F.col("vec_id") % 89).alias("entity_id"),
            F.col("embedding").alias("vector"),
            F.col("vec_id").alias("seq"),
        )
    )


def _show(df):
    """Rows with all components of the vector, as whole numbers of hundred-thousandths."""
    return df.select(
        "id",
        "entity_id",
        "shard_id",
        F.array_join(
            F.transform("vector", lambda x: F.round(x.cast("double") * 100_000).cast("long").cast("string")), ","
        ).alias("components"),
    )


_SHOW = """id, entity_id, shard_id, array_to_string(
  list_transform(vector, lambda x: round(x::DOUBLE * 100000)::BIGINT::VARCHAR), ',') AS components"""


@query("upsert_vectors", f"WITH {VEC}, {_NEW} SELECT {_SHOW} FROM merged")
def upsert(spark, sf_dir):
    return _show(vectors.upsert_vectors(stored_vectors(spark, sf_dir), _fresh(spark, sf_dir)))


@query("upsert_is_idempotent", f"WITH {VEC}, {_NEW} SELECT {_SHOW} FROM merged")
def upsert_twice(spark, sf_dir):
    fresh = _fresh(spark, sf_dir)
    once = vectors.upsert_vectors(stored_vectors(spark, sf_dir), fresh)
    return _show(vectors.upsert_vectors(once, fresh))


@query(
    "purge_vectors",
    f"""WITH {VEC}, {TOXIC} SELECT {_SHOW} FROM vec
        WHERE entity_id NOT IN (SELECT entity_id FROM toxic)""",
)
def purge(spark, sf_dir):
    return _show(
        vectors.purge_vectors(stored_vectors(spark, sf_dir), toxic_entities(spark, sf_dir))
    )


@query(
    "scan_entity_vectors",
    f"""WITH {VEC}, {TOXIC} SELECT {_SHOW} FROM vec
        WHERE entity_id IN (SELECT entity_id FROM toxic)""",
)
def scan(spark, sf_dir):
    return _show(
        vectors.entity_vectors(stored_vectors(spark, sf_dir), toxic_entities(spark, sf_dir))
    )


@query(
    "entity_in_vectors",
    f"""WITH {VEC}, asked AS (
          SELECT doc_id AS seq, 'user_' || (doc_id % 131) AS entity_id FROM labels)
        SELECT seq, entity_id, {sql_shard("entity_id")} AS shard_id,
               entity_id IN (SELECT entity_id FROM vec) AS in_vectors FROM asked""",
)
def in_vectors(spark, sf_dir):
    """Asked for more entities than there are, so some are absent."""
    asked = sharded(
        table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("seq"),
            text_of("user_", F.col("doc_id") % 131).alias("entity_id"),
        )
    )
    return vectors.entity_in_vectors(asked, stored_vectors(spark, sf_dir)).select(
        "seq", "entity_id", "shard_id", "in_vectors"
    )


@query(
    "untouched_shards_unchanged",
    f"""WITH {VEC}, {TOXIC}, gone AS (
          SELECT shard_id, entity_id FROM toxic WHERE shard_id % 2 = 0)
        SELECT CAST(s.range AS INTEGER) AS shard_id, count(v.id) AS n_before,
          count(CASE WHEN v.entity_id NOT IN (SELECT entity_id FROM gone) THEN 1 END)
            AS n_after,
          s.range IN (SELECT shard_id FROM gone) AS touched,
          count(CASE WHEN v.entity_id IN (SELECT entity_id FROM gone) THEN 1 END) = 0
            AS unchanged
        FROM range({SHARDS}) s LEFT JOIN vec v ON v.shard_id = s.range GROUP BY s.range""",
)
def isolation(spark, sf_dir):
    """Content digests around a purge of the even shards' toxic entities."""
    before = stored_vectors(spark, sf_dir)
    gone = toxic_entities(spark, sf_dir).where(F.col("shard_id") % 2 == 0)
    after = vectors.purge_vectors(before, gone)
    return vectors.untouched_shards(before, after, gone, SHARDS)
