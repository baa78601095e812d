from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from lethe.llm import exact_dedup
from lethe.llm.exact_dedup import drop_copies, find_copies
from lethe.llm.queries import QUERIES, SQL
from tests.llm.cases import awkward, awkward_rows, empty
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_query_against_sql(spark):
    name = "op6_exact_dedup"
    assert difference(spark, connect(SF_DIR), SF_DIR, QUERIES[name], SQL[name]) is None


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 4)
    rows = find_copies(awkward(spark)).collect()
    groups = {}
    for doc_id, text, *_ in awkward_rows():
        groups.setdefault(norm(text), []).append(doc_id)
    assert len(rows) == len(awkward_rows())
    by_digest = {}
    for r in rows:
        by_digest.setdefault(r.text_sha256, []).append(r)
    for text, ids in groups.items():
        own = by_digest[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert len(own) == len(ids)
        assert {r.group_size for r in own} == {len(ids)}
        assert {r.keep_id for r in own} == {min(known) if known else None}
        kept = [r for r in own if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == own[0].keep_id


def test_drop_keeps_columns_and_one_of_each(spark):
    df = awkward(spark)
    out = drop_copies(df)
    assert out.columns == df.columns
    assert out.count() == len({norm(t) for _, t, *_ in awkward_rows()})
    assert drop_copies(empty(spark)).count() == 0
    assert find_copies(empty(spark)).count() == 0


def test_many_runs(spark):
    df = spark.range(3000, numPartitions=9).select(
        (3000 - F.col("id")).alias("doc_id"), (F.col("id") % 7).cast("string").alias("text")
    )
    leaves = exact_dedup.digests(df, "doc_id", "text")
    rows = exact_dedup.merge_runs(leaves, fan_in=2, run_rows=50).collect()
    for r in rows:
        assert r.group_size in (428, 429) and r.winner.doc_id <= 7
