from __future__ import annotations

import pytest

from lethe.operators.search import search_indexed, write_search_index
from lethe.operators.telemetry import search_certificates

ROWS = [
    ("audit_1_9_abcdef01_1", "user_1", 1, "abcdef0123"),
    ("audit_1_9_abcdef01_2", "User_12", 1, "ABCDEF0199"),
    ("audit_2_9_00ff00ff_3", "ab", 2, "00ff00ff"),
    ("audit_2_9_00ff00ff_3", "ab", 2, "00ff00ff"),  # a repeated row
    ("audit_3_9_11_4", "ab cab", 31, "cabab"),
    (None, "user_12", 3, None),
]


@pytest.mark.parametrize(
    "query", ["user_1", "USER_12", "abc", "ab", "", "    ", "cabab", "zzz", "_9_", "ff0", "ab%", "user_1user"]
)
def test_index_finds_what_the_scan_finds(spark, tmp_path, query):
    ledger = spark.createDataFrame(
        [r for r in ROWS if r[0]], "audit_id string, entity_id string, shard_id int, merkle_root_hash string"
    )
    path = str(tmp_path / "index")
    write_search_index(ledger.where("shard_id < 3"), path)
    write_search_index(ledger.where("shard_id >= 3"), path)
    want = sorted(map(tuple, search_certificates(ledger, query).collect()))
    assert sorted(map(tuple, search_indexed(ledger, path, query).collect())) == want


def test_only_slices_of_the_query_are_read(spark, tmp_path):
    ledger = spark.createDataFrame(
        [r for r in ROWS if r[0]], "audit_id string, entity_id string, shard_id int, merkle_root_hash string"
    )
    path = str(tmp_path / "index")
    write_search_index(ledger, path)
    plan = search_indexed(ledger, path, "user")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert plan.count("IN (use,ser)") + plan.count("IN (ser,use)") or "In(gram" in plan
