from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lethe.llm.mixing import mix_sources, mixed_documents
from lethe.llm.queries import MIX_WEIGHTS, QUERIES, SQL
from tests.llm.cases import awkward, empty
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


def level(sizes: dict, weights: dict, most: float = 3) -> dict:
    """Targets by giving the excess away again and again."""
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        live = {s: w for s, w in weights.items() if s not in full}
        target = {s: left * w / sum(live.values()) for s, w in live.items()}
        over = {s for s in live if target[s] > most * sizes[s]}
        if not over:
            return {**full, **target}
        full |= {s: most * sizes[s] for s in over}


def test_query_against_sql(spark):
    name = "op7_mixing"
    assert difference(spark, connect(SF_DIR), SF_DIR, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("sizes", [[100, 10, 10, 1], [5, 5, 5, 5, 5], [1000, 1, 1], [7]])
def test_targets(spark, sizes):
    rows = [(100 * i + j, "w " * 1, f"s{i}") for i, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, MIX_WEIGHTS).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    want = level(dict(enumerate(sizes)), {i: MIX_WEIGHTS[i % 3] for i in range(len(sizes))})
    pairs = sorted({(sizes[i], round(t, 6)) for i, t in want.items()})
    assert sorted((r.source_size, round(r.target, 6)) for r in got) == pairs


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = mix_sources(df, MIX_WEIGHTS).collect()
    assert len(rows) == df.count()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for target in {r.target for r in rows}:
        own = [r.taken for r in rows if r.target == target]
        sources = len({r.source_size for r in rows if r.target == target})
        assert sources == 1 and abs(sum(own) - target) <= 0.5 or not sum(own)
    assert sorted(rows, key=repr) == sorted(mix_sources(df.repartition(5), MIX_WEIGHTS).collect(), key=repr)
    assert mix_sources(empty(spark), MIX_WEIGHTS).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    df = awkward(spark)
    out = mixed_documents(df, MIX_WEIGHTS)
    assert out.columns == df.columns
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    got = out.select(words.alias("w"), "n_chars", F.char_length("text").alias("n")).collect()
    taken = sum(r.taken for r in mix_sources(df, MIX_WEIGHTS).collect())
    assert sum(r.w for r in got) == taken
    assert all(r.n_chars == r.n for r in got)
    assert mixed_documents(empty(spark), MIX_WEIGHTS).count() == 0
