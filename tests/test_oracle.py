"""Registered queries against their SQL on the smallest data, and the entry contract.

The pipelines on the store and the streams have tests of their own, so here they only have to
be registered; ``python tests/oracle.py <sf dir>`` compares all of them.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from lethe import catalog
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")

SLOW = {
    "audit_requests",
    "empty_batches",
    "ingest_from_json_files",
    "ingest_into_filled_store",
    "malformed_payloads",
    "run_ingest_singles",
    "unlearn_after_crash",
    "unlearn_from_json_files",
    "concept_isolation",
    "purge_subgraph",
    "run_ingest",
    "run_ingest_batch",
    "run_unlearn",
    "stream_certificate_dedup",
    "stream_ingest",
    "stream_metrics",
    "stream_node_changes",
    "stream_node_state",
    "stream_unlearn",
    "triplets_from_tokens",
    "unlearn_and_audit",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# Results that are one row, or the top of a sorted whole; readers accumulate one row per file
# split to number the lines.
GLOBAL = {"engine_metrics", "recent_events", "read_ingest_requests", "read_unlearn_requests"}


# The training-data operators have tests of their own.
OWN = {n for n in entry.queries() if n not in catalog.QUERIES}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW - OWN))
def test_query(spark, con, name):
    def planned(spark, sf_dir):
        df = entry.queries()[name](spark, sf_dir)
        text = df._jdf.queryExecution().executedPlan().toString()
        for shape in ("CartesianProduct", "NestedLoopJoin"):
            assert shape not in text
        assert name in GLOBAL or "SinglePartition" not in text
        return df

    assert difference(spark, con, SF_DIR, planned, entry.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert all(r.is_valid for r in df.collect())


def test_every_query_has_its_sql():
    assert SLOW < set(catalog.QUERIES) == set(catalog.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())
