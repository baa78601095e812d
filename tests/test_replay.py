from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from lethe import schemas
from lethe.plans.replay import next_seq, ranked, replay_request_log
from tests.model import Handlers, random_log


def shard_of(entity):
    return zlib.crc32(entity.encode()) % 2


@pytest.mark.parametrize("span", [3, 16, 1 << 20])
def test_equals_sequential_handlers(spark, span):
    """Many logs in one job: entities and ids are prefixed by the log's number, and each log
    gets its own range of sequence numbers."""
    rng = random.Random(span)
    logs = [random_log(rng, shard_of, 60) for _ in range(40)]
    rows = []
    for n, log in enumerate(logs):
        for seq, op, entity, name, shard, k in log:
            # Shards are numbered per log so that ids of two logs never meet.
            rows.append((seq + n * 1000, op, f"{n}:{entity}", name, shard + 2 * n, k))
    rng.shuffle(rows)
    result = replay_request_log(spark.createDataFrame(rows, schemas.REQUEST_LOG), span)
    vectors, outcomes, marks, graph = set(), {}, set(), {}
    for n, log in enumerate(logs):
        done = Handlers(shard_of).apply(log)
        for (shard, name), (entity, seq) in done.slots.items():
            vectors.add((name, f"{n}:{entity}", shard + 2 * n, seq + n * 1000))
        outcomes |= {seq + n * 1000: code for seq, code in done.outcomes.items()}
        marks |= {(f"{n}:{e}", s + 2 * n, seq + n * 1000) for e, s, seq in done.marks}
        graph |= {f"{n}:{e}": k for e, k in done.edges.items()}
    assert {tuple(r) for r in result.vectors.collect()} == vectors
    assert {r.seq: r.status_code for r in result.outcomes.collect()} == outcomes
    assert {tuple(r) for r in result.marks.collect()} == marks
    assert {r.entity_id: r.edges for r in result.graph.collect()} == graph
    assert 404 in outcomes.values() and marks and graph


def test_next_seq_over_spans(spark):
    rng = random.Random(5)
    rows = [(s, rng.choice("aab"), rng.random() < 0.1) for s in rng.sample(range(2000), 600)]
    df = spark.createDataFrame(rows, "seq long, k string, wanted boolean")
    got = next_seq(df, ["k"], "wanted", "next", span=50)
    for r in got.collect():
        later = [s for s, k, w in rows if k == r.k and w and s > r.seq]
        assert r.next == (min(later) if later else None)


def test_hot_key_is_split(spark):
    """A key with most of the log: no window partition exceeds the span."""
    df = spark.range(10_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") % 100 == 0).alias("wanted"),
    )
    got = next_seq(df, ["k"], "wanted", "next", span=256)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_span" in plan
    hot = got.where("k = 'hot'").select("seq", "next").collect()
    wanted = [s for s in range(0, 10_000, 100) if s % 3 < 2]
    for r in hot:
        later = [s for s in wanted if s > r.seq]
        assert r.next == (later[0] if later else None)


@pytest.mark.parametrize("step", [1, 1 << 20])
def test_sparse_numbers_fill_spans_all_the_same(spark, step):
    """One key, numbers in large steps: windows over spans have as many rows as dense ones, and
    the one across spans only a row per span."""
    df = spark.range(4000).select(
        (F.col("id") * step).alias("seq"), F.lit("hot").alias("k"), (F.col("id") % 100 == 0).alias("wanted")
    )
    spans = ranked(df).groupBy(F.floor(F.col("_rank") / 256).alias("span")).count().collect()
    assert sorted(r["count"] for r in spans) == [4000 - 15 * 256, *[256] * 15]
    got = next_seq(df, ["k"], "wanted", "next", span=256).collect()
    for r in got:
        place = r.seq // step
        later = (place // 100 + 1) * 100
        assert r.next == (later * step if later < 4000 else None)
