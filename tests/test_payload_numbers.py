from __future__ import annotations

import json

from lethe.options import EngineOptions
from lethe.plans.ingest import run_ingest_batch
from lethe.sources import requests
from lethe.sources.store import ShardedStore


def seqs(found):
    return [r.seq for r in found.requests.orderBy("seq").collect()]


def test_payloads_of_any_length_are_numbered(spark, tmp_path):
    """More items than twenty bits count, then a short payload: no number is given twice."""
    n = (1 << 20) + 1
    lines = [json.dumps([f"e{i}" for i in range(n)]), '["last"]']
    (tmp_path / "lines.txt").write_text("\n".join(lines))
    found = requests.read_unlearn_payloads(spark, str(tmp_path))
    assert found.end == 2 * n
    rows = found.requests.selectExpr("count(*) n", "count(distinct seq) d", "max(seq) m").first()
    assert (rows.n, rows.d, rows.m) == (n + 1, n + 1, n)
    assert found.requests.where("entity_id = 'last'").first().seq == n


def test_numbers_go_on_after_the_batch_before(spark, tmp_path):
    (tmp_path / "lines.txt").write_text('["a"]\n["b", "c"]\n[]\n')
    first = requests.unlearn_payloads(requests.payload_texts(spark.read, str(tmp_path)))
    assert seqs(first) == [0, 2, 3] and first.end == 6
    then = requests.unlearn_payloads(requests.payload_texts(spark.read, str(tmp_path)), first.end)
    assert seqs(then) == [6, 8, 9] and then.end == 12


def test_the_store_keeps_the_last_number(spark, tmp_path):
    store = ShardedStore(spark, str(tmp_path / "s"), EngineOptions(1, 8, buckets=1))
    rows = spark.createDataFrame(
        [("b", 5, "d", "entity_1", "x")], "batch_id string, seq long, id string, entity_id string, text string"
    )
    assert store.numbers("in", 0) == 0
    run_ingest_batch(store, rows, 1000, source="in", batch=0, numbers=(0, 9))
    assert store.numbers("in", 0) == 0  # the same batch again
    assert ShardedStore(spark, store.root, store.options).numbers("in", 1) == 9


def test_pretty_printed_documents(spark, tmp_path):
    ingest, asked = tmp_path / "in", tmp_path / "out"
    ingest.mkdir(), asked.mkdir()
    one = {"id": "doc_1", "entity_id": "entity_1", "text": "two\nlines"}
    (ingest / "a.json").write_text("\n" + json.dumps(one, indent=2) + "\n")
    (ingest / "b.json").write_text(json.dumps([one | {"id": "doc_2"}, one | {"id": "doc_3"}], indent=4))
    (ingest / "c.json").write_text("[\n  {\n")
    (ingest / "d.json").write_text(" \n\t\n")
    found = requests.read_ingest_documents(spark, str(ingest))
    rows = found.requests.orderBy("seq").collect()
    assert [(r.seq, r.item, r.id, r.text) for r in rows] == [
        (0, 0, "doc_1", "two\nlines"), (2, 0, "doc_2", "two\nlines"), (3, 1, "doc_3", "two\nlines")
    ]
    assert sorted((r.batch_id.rsplit("/", 1)[1], r.malformed) for r in found.batches.collect()) == [
        ("a.json:0", False), ("b.json:0", False), ("c.json:0", True)
    ]
    (asked / "a.json").write_text('\n[\n  "entity_1",\n  "entity_2"\n]\n')
    (asked / "b.json").write_text('{\n  "entity_id": "entity_3"\n}')
    found = requests.read_unlearn_documents(spark, str(asked))
    assert [r.entity_id for r in found.requests.orderBy("seq").collect()] == ["entity_1", "entity_2", "entity_3"]


def test_payload_texts_are_not_shuffled(spark, tmp_path):
    """The numbers of the pieces are known to be small, so texts meet them where they lie."""
    one = {"id": "doc_1", "entity_id": "entity_1", "text": "x"}
    (tmp_path / "lines.txt").write_text("\n".join([json.dumps(one), json.dumps([one, one])]))
    found = requests.read_ingest_payloads(spark, str(tmp_path))
    plan = found.requests._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert seqs(found) == [0, 2, 3]


def test_payloads_are_parsed_once(spark, tmp_path):
    """No test of the number of requests stands below the one parse that gives them."""
    (tmp_path / "lines.txt").write_text('["a", null]\n[]\nnot one\n{"entity_id": "b"}\n')
    texts = requests.payload_texts(spark.read, str(tmp_path)).select("payload")
    plan = requests.explode_ingest(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    rows = requests.explode_unlearn(texts).collect()
    assert sorted((r.item, r.entity_id or "") for r in rows) == [(0, "a"), (0, "b"), (1, "")]
