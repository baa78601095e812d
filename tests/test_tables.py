"""Validation, sharding, vector and graph algebra on literal tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lethe import messages, schemas
from lethe.operators import graph, shards, validate, vectors
from lethe.sources import requests

REQ = "batch_id string, seq long, id string, entity_id string, text string"
VEC = "id string, entity_id string, vector array<float>, shard_id int"


def test_ingest_rules_in_order(spark):
    rows = [
        ("b", 1, "doc_1", "user_1", "x"),
        ("b", 2, "??", "user_1", " "),
        ("b", 3, "doc_3", " ", "x"),
        ("b", 4, "no", "user_1", "x"),
        ("b", 5, "doc_5", "u!", "x"),
        ("b", 6, "doc_6", "user_1", None),
    ]
    out = validate.classify_ingest(spark.createDataFrame(rows, REQ)).orderBy("seq").collect()
    blank, invalid = messages.INGEST_BLANK, messages.INGEST_INVALID
    assert [r.message for r in out] == [None, blank, blank, invalid, invalid, blank]
    assert [r.status_code for r in out] == [200, 400, 400, 400, 400, 400]


def test_one_bad_row_rejects_its_batch(spark):
    rows = [
        ("good", 1, "doc_1", "user_1", "x"),
        ("good", 2, "doc_2", "user_2", "y"),
        ("bad", 5, "doc_3", "user_1", ""),
        ("bad", 4, "!", "user_1", "x"),
        ("bad", 3, "doc_4", "user_1", "x"),
    ]
    df = spark.createDataFrame(rows, REQ)
    verdicts = validate.ingest_batch_verdicts(df)
    empty = spark.createDataFrame([("good",), ("none",)], "batch_id string")
    every = validate.with_empty_batches(verdicts, empty, messages.INGEST_EMPTY_BATCH)
    got = {r.batch_id: (r.size, r.status_code, r.message) for r in every.collect()}
    assert got == {
        "good": (2, 200, None),
        "bad": (3, 400, messages.INGEST_INVALID),
        "none": (0, 400, messages.INGEST_EMPTY_BATCH),
    }
    assert {r.seq for r in validate.accepted(df, verdicts).collect()} == {1, 2}


def test_unlearn_batch_quotes_the_first_bad_id(spark):
    rows = [("b", 2, "x%s y"), ("b", 3, "!"), ("b", 1, "user_1"), ("c", 4, "user_2")]
    df = spark.createDataFrame(rows, "batch_id string, seq long, entity_id string")
    got = {r.batch_id: r.message for r in validate.unlearn_batch_verdicts(df).collect()}
    assert got == {"b": messages.UNLEARN_INVALID_ITEM % "x%s y", "c": None}
    single = {r.seq: r.error for r in validate.classify_unlearn(df).collect()}
    assert single == {2: "INVALID_INPUT", 3: "INVALID_INPUT", 1: None, 4: None}


def test_dimension_check(spark):
    df = spark.createDataFrame(
        [("a", "e", [0.1, 0.2], 0), ("b", "e", [0.1] * 4, 0), ("c", "e", None, 0)], VEC
    )
    out = {r.id: r.message for r in validate.vector_dim_check(df, 4).collect()}
    assert out == {
        "a": "Vector dimension mismatch: expected 4, got 2",
        "c": "Vector dimension mismatch: expected 4, got 0",
    }


def test_payloads(spark):
    rows = [
        (1, '{"id": "a", "entity_id": "e", "text": "x"}'),
        (2, '[{"id": "b", "entity_id": "e", "text": "y"}, {"id": "c"}]'),
        (3, "[]"),
        (4, "nonsense"),
    ]
    df = spark.createDataFrame(rows, "n int, payload string")
    got = [(r.n, r.item, r.id, r.text) for r in requests.explode_ingest(df).collect()]
    assert sorted(got) == [(1, 0, "a", "x"), (2, 0, "b", "y"), (2, 1, "c", None)]
    rows = [(1, '{"entity_id": "a"}'), (2, ' ["b", "c"]'), (3, "[]"), (4, "{}")]
    df = spark.createDataFrame(rows, "n int, payload string")
    got = [(r.n, r.item, r.entity_id) for r in requests.explode_unlearn(df).collect()]
    assert sorted(got) == [(1, 0, "a"), (2, 0, "b"), (2, 1, "c"), (4, 0, None)]


def test_request_files(spark, tmp_path):
    (tmp_path / "lines.json").write_text(
        '{"id": "a", "entity_id": "e", "text": "x"}\n[{"id": "b", "entity_id": "e"}]\n'
    )
    (tmp_path / "array.json").write_text(
        '[\n {"id": "c",\n  "entity_id": "e", "text": "z"},\n {"id": "d"}\n]\n'
    )
    lines = requests.read_ingest_requests(spark, str(tmp_path / "lines.json"))
    assert sorted(r.id for r in lines.collect()) == ["a", "b"]
    assert lines.schema == schemas.INGEST_REQUEST
    array = requests.read_ingest_documents(spark, str(tmp_path / "array.json"))
    assert [(r.seq, r.id) for r in array.requests.orderBy("seq").collect()] == [(0, "c"), (1, "d")]
    assert [r.malformed for r in array.batches.collect()] == [False] and array.end == 2
    (tmp_path / "asked").mkdir()
    (tmp_path / "asked" / "b.txt").write_text('["a", "b"]\n{"entity_id": "c"}\n\n{"entity\n[]\n')
    (tmp_path / "asked" / "a.txt").write_text('{"entity_id": "d"}\n')
    found = requests.read_unlearn_payloads(spark, str(tmp_path / "asked"), first_seq=7)
    asked = found.requests.orderBy("seq").collect()
    assert [r.entity_id for r in asked] == ["d", "a", "b", "c"]
    # Two numbers per payload, as the largest has two items, for all five of them.
    assert [r.seq for r in asked] == [7, 9, 10, 11] and found.end == 7 + 2 * 5
    names = {r.batch_id.rsplit("/", 1)[1]: r.malformed for r in found.batches.collect()}
    assert names == {"a.txt:0": False, "b.txt:0": False, "b.txt:1": False, "b.txt:2": True, "b.txt:3": False}


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    lines = [f'["e{i}", "f{i}"]' for i in range(500)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    whole = requests.read_unlearn_payloads(spark, str(tmp_path)).requests.collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = requests.read_unlearn_payloads(spark, str(tmp_path)).requests
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert sorted(split.collect()) == sorted(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r.seq for r in whole}) == 1000


def test_topology_counts_empty_shards(spark):
    df = spark.createDataFrame([("d1", "only_one"), ("d2", "only_one")], "id string, entity_id string")
    out = shards.shard_topology(df, 8).collect()
    assert len(out) == 8 and sum(r.docs for r in out) == 2
    assert sorted(r.entities for r in out) == [0] * 7 + [1]


def test_upsert_matches_sequential_inserts(spark):
    rng = random.Random(11)
    fields = "id string, entity_id string, vector array<float>, shard_id int"

    def row(i):
        entity = rng.randrange(6)
        return (f"v{rng.randrange(12)}", f"e{entity}", [float(i)], entity % 2)

    slots = {}
    base_rows = [row(i) for i in range(8)]
    for r in base_rows:
        slots[r[3], r[0]] = r
    base = spark.createDataFrame(list(slots.values()), fields)
    new_rows = [(*row(100 + i), i) for i in range(60)]
    for r in new_rows:
        slots[r[3], r[0]] = r[:4]
    new = spark.createDataFrame(new_rows, fields + ", seq long")
    once = vectors.upsert_vectors(base, new)
    assert sorted(map(tuple, once.collect())) == sorted(slots.values())
    twice = vectors.upsert_vectors(once, new)
    assert sorted(map(tuple, twice.collect())) == sorted(slots.values())


def test_purge_touches_only_the_entity(spark):
    rows = [(f"v{i}", f"e{i % 4}", [0.5, float(i)], i % 4 % 2) for i in range(40)]
    base = spark.createDataFrame(rows, VEC)
    purged = spark.createDataFrame([("e1", 1), ("e1", 1), ("e3", 0)], "entity_id string, shard_id int")
    after = vectors.purge_vectors(base, purged)
    assert {r.entity_id for r in after.collect()} == {"e0", "e2", "e3"}  # e3 is not on shard 0
    report = {r.shard_id: r for r in vectors.untouched_shards(base, after, purged, 3).collect()}
    assert (report[0].touched, report[0].unchanged, report[0].n_after) == (True, True, 20)
    assert (report[1].touched, report[1].unchanged, report[1].n_after) == (True, False, 10)
    assert (report[2].touched, report[2].unchanged, report[2].n_before) == (False, True, 0)
    asked = spark.createDataFrame([("e1", 1), ("e0", 0), ("nobody", 0)], "entity_id string, shard_id int")
    found = vectors.entity_in_vectors(asked, after).collect()
    assert {r.entity_id: r.in_vectors for r in found} == {"e1": False, "e0": True, "nobody": False}


def test_digest_sees_repeated_rows(spark):
    one = spark.createDataFrame([("v", "e", [1.0], 0)], VEC)
    pair = one.unionByName(one).unionByName(one.withColumn("id", F.lit("w")))
    other = one.unionByName(pair.where("id = 'w'")).unionByName(pair.where("id = 'w'"))
    a, b = (vectors.shard_digests(x, 1).first() for x in (pair, other))
    assert a.n_rows == b.n_rows == 3
    assert (a.digest_xor, a.digest_sum) != (b.digest_xor, b.digest_sum)


TRIPLET = "subject string, predicate string, object string, shard_id int, entity_id string"
ALICE = ("Alice", "LIVES_IN", "Paris", 1, "entity_alice")
BOB = ("Bob", "VISITED", "Paris", 2, "entity_bob")


def test_shared_names_stay_apart(spark):
    rows = spark.createDataFrame([ALICE, BOB, ALICE], TRIPLET)
    concept = graph.concepts_of(rows)
    assert sorted(r.concept_id for r in concept.collect()) == [
        "entity_alice:Alice",
        "entity_alice:Paris",
        "entity_bob:Bob",
        "entity_bob:Paris",
    ]
    now = F.timestamp_seconds(F.lit(5))
    knowledge = graph.knowledge_rows(rows, now)
    assert knowledge.count() == 3  # repeats are kept
    purged = spark.createDataFrame([("entity_bob", 2)], "entity_id string, shard_id int")
    edges, nodes = graph.purge_subgraph(knowledge, concept, purged)
    assert {r.entity_id for r in edges.collect()} == {"entity_alice"}
    assert nodes.count() == 2
    report = {r.entity_id: r for r in graph.concept_isolation(concept, nodes, purged).collect()}
    assert report["entity_alice"].isolated and report["entity_alice"].n_after == 2
    assert report["entity_bob"].isolated and report["entity_bob"].n_after == 0
    again = graph.upsert_concepts(nodes, rows)
    assert again.count() == 4
    assert graph.upsert_concepts(again, rows).count() == 4


def test_purge_marks(spark):
    entity = spark.createDataFrame([], schemas.ENTITY)
    shard = spark.createDataFrame([], schemas.SHARD)
    marks = spark.createDataFrame([], schemas.PURGED_FROM)
    purges = spark.createDataFrame(
        [("e1x", 1, 10), ("e1x", 1, 20), ("e2x", 0, 30)], "entity_id string, shard_id int, t long"
    ).withColumn("timestamp", F.timestamp_seconds("t"))
    entity, shard, marks = graph.record_purge(entity, shard, marks, purges)
    assert entity.count() == 2 and shard.count() == 2 and marks.count() == 3
    hit = graph.affected_shards(entity, marks, shard).collect()
    assert sorted(map(tuple, hit)) == [("e1x", 1), ("e1x", 1), ("e2x", 0)]
    later = spark.createDataFrame([("a", "P", "b", 1, "e1x")], TRIPLET)
    assert {r.entity_id for r in graph.clear_purge_marks(marks, later).collect()} == {"e2x"}
    assert graph.clear_purge_marks(marks, later.limit(0)).count() == 3


@pytest.mark.parametrize("hot", ["user_hot"])
def test_hot_slot(spark, hot):
    """Half of the batch writes one slot; the last write wins."""
    new = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, hot).otherwise(F.col("id").cast("string")).alias("id"),
        F.lit("e").alias("entity_id"),
        F.array(F.col("id").cast("float")).alias("vector"),
        F.lit(0).alias("shard_id"),
        F.col("id").alias("seq"),
    )
    out = vectors.upsert_vectors(spark.createDataFrame([], VEC), new)
    assert out.count() == 10_001
    assert out.where(F.col("id") == hot).first().vector == [19_998.0]
