from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.functions import ed25519
from lethe.functions.arrays import l2_norm, l2_normalise
from lethe.functions.hashing import assign_bucket, assign_shard
from lethe.functions.text import (
    contains_folded,
    error_message,
    has_content,
    non_blank,
    short_hash,
    strip,
    valid_identifier,
)
from lethe.options import EngineOptions


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


@pytest.mark.parametrize(
    "value", ["user_123", "doc-456", "entity_alpha_beta", "SHARD-99", "abc", "a" * 64]
)
def test_identifier_accepted(spark, value):
    assert column(spark, [value], valid_identifier) == [True]


def test_identifier_rejected(spark):
    bad = ["", "a", "ab", "a" * 65, "user@123", "user 123", "user.name", "user$id"]
    bad += ["entity#42", "<script>", "user;DROP TABLE", "abc\n", "\nabc", "äbc", None]
    assert column(spark, bad, valid_identifier) == [False] * len(bad)


def test_blank_text(spark):
    blank = ["", " ", "\t\n", " ", "　", "\u0085", "   ", None]
    assert column(spark, blank, non_blank) == [False] * len(blank)
    filled = ["x", " x ", "​", "\u001c"]
    assert column(spark, filled, non_blank) == [True] * len(filled)
    # The worker also counts the ASCII separators as blank.
    assert column(spark, ["\u001c", "\u001f \u001d", "x\u001c"], has_content) == [
        False,
        False,
        True,
    ]


def test_strip(spark):
    values = ["  a b ", " x　", "\u001cx\u001f", "x", ""]
    assert column(spark, values, strip) == ["a b", "x", "x", "x", ""]


def test_short_hash(spark):
    digest = "0123456789abcdef" * 4
    assert column(spark, [digest, "", None], lambda c: short_hash(c, "none")) == [
        "0123456789...89abcdef",
        "none",
        "none",
    ]


def test_contains_is_literal(spark):
    values = ["a_b", "axb", "A%B", None]
    assert column(spark, values, lambda c: contains_folded(c, "A_B")) == [
        True,
        False,
        False,
        False,
    ]


def test_error_message(spark):
    bodies = ["", None, '{"error": "E", "message": "gone"}', "plain", '{"message": 5}']
    bodies += ['{"message": " "}', "{broken", '"text"', "null", '{"other": 1}']
    assert column(spark, bodies, lambda c: error_message(c, "none")) == [
        "none",
        "none",
        "gone",
        *bodies[3:],
    ]


@pytest.mark.parametrize("shards", [2, 4, 8, 16])
def test_shard_bounds(spark, shards):
    ids = [f"entity_sample_{i}" for i in range(100)]
    first = column(spark, ids, lambda c: assign_shard(c, shards))
    assert first == column(spark, ids, lambda c: assign_shard(c, shards))
    assert set(first) == set(range(shards))


def test_zero_shards_act_as_one(spark):
    assert column(spark, ["any_entity"], lambda c: assign_shard(c, 0)) == [0]
    assert EngineOptions(num_shards=0).num_shards == 1


def test_bucket_is_independent_of_shard(spark):
    ids = [f"entity_{i}" for i in range(400)]
    shard = column(spark, ids, lambda c: assign_shard(c, 4))
    bucket = column(spark, ids, lambda c: assign_bucket(c, 4))
    assert len(set(zip(shard, bucket, strict=True))) == 16


def test_options_from_env():
    assert EngineOptions.from_env({}).num_shards == 4
    assert EngineOptions.from_env({"NUM_SISA_SHARDS": "8"}).num_shards == 8
    for bad in ("0", "x", "-1", "", "4.5", str(2**32)):
        assert EngineOptions.from_env({"NUM_SISA_SHARDS": bad}).num_shards == 4
    assert EngineOptions().dimension == 384


def test_l2_normalise(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.normal(size=16)] for _ in range(20)] + [[0.0] * 16]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    rows = df.select(l2_normalise(F.col("v")).alias("u"), l2_norm(F.col("v")).alias("n"))
    for row, vector in zip(rows.collect(), vectors, strict=True):
        norm = np.linalg.norm(np.float32(vector))
        assert row.n == pytest.approx(norm, rel=1e-5)
        expected = np.array(vector) / norm if norm else np.zeros(16)
        assert np.allclose(row.u, expected, atol=1e-6)


# Test vectors 1 to 3 of RFC 8032, section 7.1: private key, public key, message, signature.
RFC_8032 = [
    (
        "9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60",
        "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a",
        "",
        "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555"
        "fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b",
    ),
    (
        "4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb",
        "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c",
        "72",
        "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da0"
        "85ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00",
    ),
    (
        "c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7",
        "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025",
        "af82",
        "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac1"
        "8ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a",
    ),
]


@pytest.mark.parametrize(("private", "public", "message", "signature"), RFC_8032)
def test_rfc_8032(private, public, message, signature):
    key, text = bytes.fromhex(private), bytes.fromhex(message)
    assert ed25519.public_key(key).hex() == public
    assert ed25519.sign_all(key, [text])[0].hex() == signature
    good = (text, bytes.fromhex(signature))
    assert ed25519.verify_all(bytes.fromhex(public), [good]) == [True]


def test_bad_signatures_are_false():
    key = bytes(range(32))
    public = ed25519.public_key(key)
    signature = ed25519.sign_all(key, [b"m"])[0]
    s = int.from_bytes(signature[32:], "little")
    malleable = signature[:32] + (s + ed25519.L).to_bytes(32, "little")
    flipped = bytes([signature[0] ^ 1]) + signature[1:]
    pairs = [(b"n", signature), (b"m", flipped), (b"m", malleable), (b"m", signature[:63])]
    assert ed25519.verify_all(public, pairs) == [False] * 4
    assert ed25519.verify_all(ed25519.public_key(bytes(32)), [(b"m", signature)]) == [False]
    assert ed25519.verify_all(public, []) == []
    assert ed25519.verify_all(b"\xff" * 32, [(b"m", signature)]) == [False]


def test_private_key_is_never_replaced_silently():
    name = ed25519.PRIVATE_KEY_ENV
    assert ed25519.load_private_key({name: " " + "ab" * 32 + "\n"}) == b"\xab" * 32
    for bad in ("", "zz", "ab" * 31, "ab" * 33):
        with pytest.raises(ValueError, match="32 bytes"):
            ed25519.load_private_key({name: bad}, ephemeral=True)
    with pytest.raises(ValueError, match="not set"):
        ed25519.load_private_key({})
    assert len(ed25519.load_private_key({}, ephemeral=True)) == 32
