from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lethe import messages, schemas
from lethe.functions import ed25519
from lethe.operators import certificates as C
from lethe.operators import telemetry as W
from lethe.sources import export

KEY = bytes(range(32))
PUBLIC = ed25519.public_key(KEY)
PURGE = "entity_id string, shard_id int, timestamp_epoch long, seq long"
LITERAL = [
    ("patient_9012", 2, 1690000000, 1),
    ("entity_alpha", 0, 1690000000, 2),
    ("entity_beta", 1, 1690000001, 3),
    ("user_4040", 3, 1690000002, 4),
    ("patient_verify_1", 1, 1690000003, 5),
]


@pytest.fixture(scope="module")
def ledger(spark):
    return C.issue_certificates(spark.createDataFrame(LITERAL, PURGE), KEY).cache()


def test_fields(ledger):
    for r in ledger.collect():
        payload = f"{r.entity_id}:{r.shard_id}:{r.timestamp_epoch}"
        digest = hashlib.sha256(payload.encode()).hexdigest()
        assert r.merkle_root_hash == digest
        assert r.audit_id == f"audit_{r.shard_id}_{r.timestamp_epoch}_{digest[:8]}_{r.seq}"
        assert r.status == "VERIFIED_PURGED"
        assert r.signature == ed25519.sign_all(KEY, [digest.encode()])[0].hex()


def test_tampering(ledger):
    changes = {
        "none": {},
        "upper-case signature": {"signature": F.upper("signature")},
        "status": {"status": F.lit("EDITED")},
        "entity": {"entity_id": F.lit("patient_verify_2")},
        "shard": {"shard_id": F.col("shard_id") + 1},
        "epoch": {"timestamp_epoch": F.col("timestamp_epoch") + 1},
        "hash": {"merkle_root_hash": F.lit("0" * 64)},
        "upper-case hash": {"merkle_root_hash": F.upper("merkle_root_hash")},
        "null hash": {"merkle_root_hash": F.lit(None).cast("string")},
        "signature": {"signature": F.lit("f" * 128)},
        "short signature": {"signature": F.substring("signature", 1, 126)},
        "no hex": {"signature": F.lit("g" * 128)},
        "null signature": {"signature": F.lit(None).cast("string")},
    }
    whole = {"none", "upper-case signature", "status"}
    rows = None
    for name, columns in changes.items():
        part = ledger.withColumns(columns).withColumn("change", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    for r in C.verify_certificates(rows, PUBLIC).collect():
        assert r.cert_valid == (r.change in whole), r.change
    other = C.verify_certificates(ledger, ed25519.public_key(bytes(32))).collect()
    assert all(r.hash_valid and not r.signature_valid for r in other)


def test_same_second(spark):
    rows = [("entity_same_sec_a", 0, 7, 1), ("entity_same_sec_a", 0, 7, 2)]
    rows += [("entity_same_sec_b", 0, 7, 3), ("entity_same_sec_a", 0, 6, 9)]
    ledger = C.issue_certificates(spark.createDataFrame(rows, PURGE), KEY)
    assert ledger.select("audit_id").distinct().count() == 4
    latest = {r.entity_id: r.seq for r in C.latest_certificate(ledger).collect()}
    assert latest == {"entity_same_sec_a": 2, "entity_same_sec_b": 3}


def test_verdicts(spark, ledger):
    """Every reason, in the order of precedence."""
    num_shards = 1
    names = ["valid", "no_relation", "in_vectors", "in_graph", "no_cert", "forged"]
    pairs = spark.createDataFrame([(n, 0) for n in names], "entity_id string, shard_id int")
    purges = pairs.where("entity_id <> 'no_cert'").select(
        "*", F.lit(5).cast("long").alias("timestamp_epoch"), F.crc32("entity_id").alias("seq")
    )
    issued = C.issue_certificates(purges, KEY).withColumn(
        "signature", F.when(F.col("entity_id") == "forged", "00" * 64).otherwise(F.col("signature"))
    )
    marks = pairs.where("entity_id <> 'no_relation'")
    stores = {
        "entity": marks.select("entity_id"),
        "marks": marks,
        "shard": spark.createDataFrame([(0,)], "shard_id int"),
        "vectors": pairs.where("entity_id = 'in_vectors'"),
        "concept": pairs.where("entity_id = 'in_graph'"),
        "num_shards": num_shards,
    }
    asked = pairs.unionByName(pairs).unionByName(
        spark.createDataFrame([("x!", 0), ("valid", 3)], "entity_id string, shard_id int")
    )
    checked = C.verify_certificates(C.latest_certificate(issued), PUBLIC)
    out = C.audit_verdict(asked, certificates=checked, **stores).collect()
    assert len(out) == 14
    got = {(r.entity_id, r.shard_id): r for r in out}
    assert {n: got[n, 0].is_valid for n in names} == {n: n == "valid" for n in names}
    assert got["valid", 0].message == messages.AUDIT_VALID % ("valid", 0)
    assert got["no_relation", 0].message == messages.AUDIT_NO_RELATION % ("no_relation", 0)
    for n in ("in_vectors", "in_graph"):
        assert got[n, 0].message == messages.AUDIT_STILL_ACTIVE % n
    for n in ("no_cert", "forged"):
        assert got[n, 0].message == messages.AUDIT_BAD_CERTIFICATE % (n, 0)
    none = got["no_cert", 0]
    assert (none.audit_id, none.merkle_root_hash, none.signature, none.timestamp_epoch) == (
        "unverified_0_no_cert",
        "",
        "",
        0,
    )
    assert none.status == "UNVERIFIED"
    # The right entity on a shard it was never purged from.
    assert not got["valid", 3].is_valid
    assert got["valid", 3].message == messages.AUDIT_NO_RELATION % ("valid", 3)
    assert got["x!", 0].status_code == 400 and got["x!", 0].message == messages.UNLEARN_INVALID
    assert got["valid", 0].status_code == 200
    whole = C.audit_ledger(issued, PUBLIC, **stores).collect()
    assert {r.entity_id for r in whole} == set(names) - {"no_cert"}
    assert {r.entity_id for r in whole if r.is_valid} == {"valid"}


def test_ledger_search(spark):
    row = ("audit_0_123", "patient_alpha", 0, "abcdef" + "0" * 58, "", 1690000000, "s")
    ledger = spark.createDataFrame([row], schemas.CERTIFICATE)
    for query in ("", "  ", "ALPHA", "0", "T_0_1", "ABCDEF"):
        assert W.search_certificates(ledger, query).count() == 1
    for query in ("beta", "a%a", "alph_"):
        assert W.search_certificates(ledger, query).count() == 0


def test_exports(spark, ledger, tmp_path):
    import json

    path = str(tmp_path / "array")
    export.export_ledger_array(ledger.repartition(3), path)
    parts = sorted((tmp_path / "array").glob("part-*"))
    parsed = json.loads("".join(p.read_text() for p in parts))
    assert [c["audit_id"] for c in parsed] == sorted(r.audit_id for r in ledger.collect())
    assert list(parsed[0]) == schemas.CERTIFICATE.fieldNames()
    export.export_ledger_array(ledger.limit(0), str(tmp_path / "none"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))
    assert json.loads(text) == []
    export.export_ledger_lines(ledger, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 5
    receipt = export.receipts(ledger).first()
    assert json.loads(receipt.receipt)["audit_id"] in receipt.file_name
