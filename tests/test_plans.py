"""Shapes of the physical plans: what must and must not be in them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lethe.operators import triplets, vectors
from lethe.options import EngineOptions
from lethe.operators.shards import with_cell
from lethe.sources.store import ShardedStore, touched_cells
from tests.test_oracle import SF_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_events_is_a_top_k(spark):
    text = plan(entry.queries()["recent_events"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text


def test_extraction_reads_one_column_once_without_shuffle(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = triplets.triplet_rows(triplets.extract_triplets(docs), "doc_id")
    text = plan(rows)
    assert "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert text.count("regexp_extract_all") == 1


def test_existence_check_does_not_read_vectors(spark):
    base = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("id"),
        F.lit("e").alias("entity_id"),
        F.col("embedding").alias("vector"),
        (F.col("label") % 4).alias("shard_id"),
    )
    text = plan(vectors.present_entities(base))
    assert "embedding" not in text.split("ReadSchema")[1]


def test_repeated_slots_do_not_shuffle_vectors(spark):
    """Only slots are aggregated; the vectors meet the few repeated ones by broadcast."""
    new = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("id"),
        F.lit("e").alias("entity_id"),
        F.col("embedding").alias("vector"),
        (F.col("label") % 4).alias("shard_id"),
        F.col("vec_id").alias("seq"),
    )
    text = plan(vectors.latest_per_slot(new))
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in text
    assert "struct<vec_id:bigint,label:int>" in text.split("Exchange hashpartitioning")[1]


def test_store_scan_is_pruned(spark, tmp_path):
    options = EngineOptions(num_shards=4, dimension=64, buckets=4)
    store = ShardedStore(spark, str(tmp_path / "store"), options)
    rows = spark.range(2000).select(
        F.col("id").cast("string").alias("id"),
        F.concat(F.lit("entity_"), (F.col("id") % 50).cast("string")).alias("entity_id"),
        F.array(F.lit(1.0).cast("float")).alias("vector"),
    )
    change = store.begin()
    change.append("vectors", with_cell(rows, options))
    change.commit()
    one = with_cell(rows.where("entity_id = 'entity_7'"), options)
    cells = touched_cells(one)
    assert len(cells) == 1 and len(store.cells("vectors")) > 8
    scan = store.read("vectors", cells).where("entity_id = 'entity_7'").select("id")
    text = plan(scan)
    assert "EqualTo(entity_id,entity_7)" in text and "vector" not in text.split("ReadSchema")[1]
    (shard, bucket) = cells.pop()
    assert all(f"shard_id={shard}/bucket={bucket}" in f for f in scan.inputFiles())
    assert scan.count() == 40
