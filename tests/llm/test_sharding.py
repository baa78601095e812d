from __future__ import annotations

import math
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from lethe.llm.queries import QUERIES
from lethe.llm.sharding import assign_shards, number_slots
from tests.llm.cases import awkward, empty

SF_DIR = "/root/testdata/sf0.001"


def brute(doc_id: int, weights: dict[int, float]) -> int:
    seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
    best = None
    for shard, weight in weights.items():
        draw = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=seed)
        score = math.log(((draw >> 11) + 0.5) * 2.0**-53) / weight
        best = max(best, (score, shard)) if best else (score, shard)
    return best[1]


def test_query_places_all_rows(spark):
    rows = QUERIES["op1_sharding"](spark, SF_DIR).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].encode()) + 8
        assert r.shard == brute(r.doc_id, dict.fromkeys(range(24), 1.0))
        assert r.grown_shard == brute(r.doc_id, dict.fromkeys(range(25), 1.0))
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_few_moves(spark):
    keys = spark.range(20_000)
    weights = {0: 1.0, 1: 2.0, 5: 1.0, 7: 0.0}
    less = {0: 1.0, 1: 2.0}
    rows = assign_shards(keys, "id", weights, grown=less).collect()
    share = Counter(r.shard for r in rows)
    assert set(share) == {0, 1, 5}
    assert abs(share[1] / len(rows) - 0.5) < 0.02
    assert all(r.shard == r.grown_shard for r in rows if r.shard != 5)


def test_awkward_rows(spark):
    df = awkward(spark)
    out = number_slots(assign_shards(df, "doc_id", {0: 1.0, 1: 1.0}))
    rows = out.collect()
    assert len(rows) == df.count() and set(df.columns) < set(out.columns)
    for shard in (0, 1):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert number_slots(assign_shards(empty(spark), "doc_id", {0: 1.0})).count() == 0


def test_hot_key_is_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr("lethe.llm.sharding.BLOCK", 16)
    hot = spark.range(1000).select(F.lit(7).alias("doc_id"))
    rows = number_slots(assign_shards(hot, "doc_id", {0: 1.0, 1: 1.0})).collect()
    assert sorted(r.slot for r in rows) == list(range(1000))
