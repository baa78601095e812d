from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lethe import messages
from lethe.operators import telemetry as W
from lethe.operators.certificates import proof_label, unsigned_certificates
from lethe.streaming import telemetry as X


def build(spark, log):
    """Event table of (seq, op, entity, id) rows."""
    df = spark.createDataFrame(log, "seq long, op string, entity_id string, id string")
    df = df.withColumn("shard_id", F.lit(1))
    purges = df.where("op = 'U'").withColumn("timestamp_epoch", F.col("seq") + 1000)
    certs = unsigned_certificates(purges).withColumn("signature", F.lit("ab"))
    return W.ingest_events(df.where("op = 'I'")).unionByName(W.unlearn_events(certs))


def random_events(seed, n=300):
    rng = random.Random(seed)
    log = []
    for seq in range(n):
        entity = f"ent_{min(rng.randrange(6), rng.randrange(6))}"
        if rng.random() < 0.15:
            log.append((seq, "U", entity, None))
        else:
            log.append((seq, "I", entity, f"doc_{rng.randrange(9)}"))
    return log


def fold(log):
    """The client's fold, one event at a time."""
    nodes = {}
    for seq, op, entity, name in sorted(log):
        if op == "I":
            nodes.setdefault((entity, name), [seq, "active"])
        else:
            for (owner, _), node in nodes.items():
                if owner == entity:
                    node[1] = "purged"
    return {key: tuple(value) for key, value in nodes.items()}


def test_wire_form(spark):
    events = build(spark, [(1, "I", "e_1", "d_1"), (2, "U", "e_1", None)])
    rows = events.select("seq", "ord", W.event_json().alias("j")).orderBy("seq", "ord").collect()
    assert [(r.seq, r.ord) for r in rows] == [(1, 0), (2, 0), (2, 1)]
    parsed = [json.loads(r.j) for r in rows]
    assert parsed[0] == {
        "type": "NodeIngested",
        "payload": {"id": "d_1", "entity_id": "e_1", "shard_id": 1},
    }
    assert parsed[1] == {"type": "NodeDeleted", "payload": {"entity_id": "e_1", "shard_id": 1}}
    assert parsed[2]["type"] == "AuditGenerated"
    certificate = parsed[2]["payload"]["audit_certificate"]
    assert list(certificate) == [
        "audit_id",
        "entity_id",
        "shard_id",
        "merkle_root_hash",
        "signature",
        "timestamp_epoch",
        "status",
    ]
    assert W.search_events(events, "nodeDELETED").count() == 1
    assert W.search_events(events, " ").count() == 3
    stamped = W.stamp_events(events, F.timestamp_seconds(F.lit(9))).first()
    assert stamped.timestamp is not None


@pytest.mark.parametrize("seed", [1, 2])
def test_views_match_the_fold(spark, seed):
    log = random_events(seed)
    events, expected = build(spark, log), fold(log)
    nodes = W.node_state(events)
    got = {(r.entity_id, r.id): (r.created_seq, r.status) for r in nodes.collect()}
    assert got == expected
    links = {(r.target, r.visible) for r in W.node_links(events, nodes).collect()}
    assert links == {
        (f"entity_{e}_{i}", status == "active") for (e, i), (_, status) in expected.items()
    }
    assert W.node_links(events).count() == len(expected)
    active = {r.entity_id for r in W.active_entities(nodes).collect()}
    assert active == {e for (e, _), (_, status) in expected.items() if status == "active"}
    feed = W.certificate_feed(events.unionByName(events))
    unlearns = [row for row in log if row[1] == "U"]
    assert feed.count() == len(unlearns)
    metrics = W.engine_metrics(nodes, feed, 4).first()
    assert metrics.ingested_entities == len(expected)
    assert metrics.purged_entities == sum(s == "purged" for _, s in expected.values())
    newest = feed.orderBy(F.desc("seq")).first().merkle_root_hash
    assert metrics.latest_merkle_root == newest


def test_purged_stays_purged(spark):
    log = [(1, "I", "e_1", "d_1"), (2, "U", "e_1", None), (3, "I", "e_1", "d_1")]
    log += [(4, "I", "e_1", "d_2")]
    got = {r.id: r.status for r in W.node_state(build(spark, log)).collect()}
    assert got == {"d_1": "purged", "d_2": "active"}


def test_joined_names_do_not_merge_nodes(spark):
    log = [(1, "I", "abc", "x_yyy"), (2, "I", "abc_x", "yyy"), (3, "U", "abc", None)]
    nodes = W.node_state(build(spark, log)).collect()
    assert {r.node_id for r in nodes} == {"entity_abc_x_yyy"}
    assert sorted(r.status for r in nodes) == ["active", "purged"]


def test_empty_log(spark):
    events = build(spark, [(1, "I", "e_1", "d_1")]).limit(0)
    metrics = W.engine_metrics(W.node_state(events), W.certificate_feed(events), 4).first()
    assert (metrics.ingested_entities, metrics.latest_merkle_root) == (0, "")
    assert metrics.short_root == messages.HASH_PLACEHOLDER


def test_recent(spark):
    events = build(spark, random_events(3))
    rows = W.recent_events(events, 10).collect()
    everything = sorted(((r.seq, r.ord) for r in events.collect()), reverse=True)
    assert [(r.seq, r.ord) for r in rows] == everything[:10]


def test_proof_label(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, v boolean")
    rows = df.select("i", proof_label(F.col("v")).alias("l")).orderBy("i").collect()
    assert [r.l for r in rows] == [
        messages.PROOF_RECORDED,
        messages.PROOF_MISSING,
        messages.PROOF_MISSING,
    ]


def test_node_stream_over_many_batches(spark, tmp_path):
    """Files arrive out of order; the change log still folds to the same nodes."""
    log = random_events(4)
    events = build(spark, log)
    shuffled = events.collect()
    random.Random(9).shuffle(shuffled)
    source = tmp_path / "in"
    for i in range(0, len(shuffled), 120):
        spark.createDataFrame(shuffled[i : i + 120], events.schema).coalesce(1).write.mode(
            "append"
        ).parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)

    def run(df, name, mode="append", **kind):
        writer = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / name))
        writer = writer.foreachBatch(kind["each"]) if kind else writer.format("parquet").option(
            "path", str(tmp_path / f"{name}_out")
        )
        writer.trigger(availableNow=True).start().awaitTermination()

    folder = str(tmp_path / "nodes_out")
    writer = X.stream_node_changes(stream.parquet(str(source)), folder)
    writer = writer.option("checkpointLocation", str(tmp_path / "nodes"))
    writer.trigger(availableNow=True).start().awaitTermination()
    changes = X.read_node_changes(spark, folder)
    got = {
        (r.entity_id, r.id): (r.created_seq, r.status)
        for r in X.nodes_from_changes(changes).collect()
    }
    expected = fold(log)
    assert got == expected
    total = changes.agg(F.sum("new_node"), F.sum("new_purge")).first()
    purged = sum(s == "purged" for _, s in expected.values())
    assert tuple(total) == (len(expected), purged)

    batches: dict[str, list] = {"first": [], "deletes": []}
    for name, build_stream in (
        ("first", X.stream_first_ingests),
        ("deletes", X.stream_last_deletes),
    ):
        df = build_stream(stream.parquet(str(source)))
        run(df, name, "update", each=lambda rows, batch, n=name: batches[n].extend(rows.collect()))
        batches[name] = spark.createDataFrame(batches[name], df.schema)
    folded = X.nodes_from_updates(batches["first"], batches["deletes"]).collect()
    assert {(r.entity_id, r.id): (r.created_seq, r.status) for r in folded} == expected

    run(X.stream_certificates(stream.parquet(str(source))), "certs")
    certs = spark.read.parquet(str(tmp_path / "certs_out"))
    assert certs.count() == sum(row[1] == "U" for row in log)

    metrics = X.read_metrics(spark, folder, 4).first()
    assert (metrics.ingested_entities, metrics.purged_entities) == (len(expected), purged)
    newest = events.where("type = 'AuditGenerated'").orderBy(F.desc("seq")).first()
    assert metrics.latest_merkle_root == newest.payload.audit_certificate.merkle_root_hash


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """The second micro-batch is applied twice, as after a crash: same log, same totals."""
    log = random_events(6)
    events = build(spark, log)
    half = max(r[0] for r in log) // 2
    parts = [events.where(F.col("seq") <= half), events.where(F.col("seq") > half)]
    applied = {}

    class Stream:
        sparkSession = spark

        class writeStream:  # noqa: N801
            @staticmethod
            def foreachBatch(fn):  # noqa: N802
                applied["fn"] = fn

    X.stream_node_changes(Stream(), str(tmp_path / "n"))
    applied["fn"](parts[0], 0)
    for _ in range(2):
        applied["fn"](parts[1], 1)
        metrics = X.read_metrics(spark, str(tmp_path / "n"), 4).first()
        expected = fold(log)
        purged = sum(s == "purged" for _, s in expected.values())
        assert (metrics.ingested_entities, metrics.purged_entities) == (len(expected), purged)
        rows = X.nodes_from_changes(X.read_node_changes(spark, str(tmp_path / "n"))).collect()
        assert {(r.entity_id, r.id): (r.created_seq, r.status) for r in rows} == expected


def test_change_log_needs_no_python(spark):
    events = build(spark, random_events(1))
    log = spark.createDataFrame([], X.CHANGE)
    plan = X.node_changes(events, log)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan
