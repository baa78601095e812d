from __future__ import annotations

import math

import numpy as np
import pytest

from lethe.llm.queries import QUERIES, SQL
from lethe.llm.topk import quantised, search_embeddings, top_k
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, row int, v int"


def test_query_against_sql(spark):
    name = "op9_top_k_search"
    assert difference(spark, connect(SF_DIR), SF_DIR, QUERIES[name], SQL[name]) is None


def brute(rows, k, scale=256):
    live = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v])
        for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (qid, q) in enumerate(live):
        if qid % 50:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(q, v, strict=False)), i)
            for b, (i, v) in enumerate(live)
            if a != b
        )
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, [1.0, nan]),
        (5, [inf]), (6, [1.0, None]), (None, [9.0, 9.0]), (7, []), (50, [0.5]), (50, [0.5]),
        (8, [-1.0, -2.0, -3.0, -4.0]), (100, [1e6, -1e6]), (9, [3e6] * 70), (10, [0.0] * 3),
    ]
    rows = [(i, v, 1, 2) for i, v in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    got = search_embeddings(df, lambda i: i % 50 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows, 5)
    none = search_embeddings(spark.createDataFrame([], SCHEMA), lambda i: i % 50 == 0)
    assert none.count() == 0


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_pruning_loses_nothing(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 40))
    rows = [
        (i, (centres[i % 12] + spread * rng.normal(size=40)).astype("f4").tolist(), 0, 0)
        for i in range(700)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = quantised(df.coalesce(1), "vec_id", "embedding", 256)
    got = top_k(whole, whole.where("vec_id % 50 = 0"), 5, block_rows=100, query_rows=4)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows, 5)


def test_pairs_of_blocks_are_not_collected_on_the_driver(spark):
    """However small the written blocks are, no side is broadcast, nor copied for a shuffle."""
    rows = [(i, [float(i % 7), 1.0], 0, 0) for i in range(300)]
    whole = quantised(spark.createDataFrame(rows, SCHEMA).coalesce(1), "vec_id", "embedding", 256)
    found = top_k(whole, whole.where("vec_id % 50 = 0"), 5, block_rows=50, query_rows=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the ranking's
    assert "CartesianProduct" in plan
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute(rows, 5)
