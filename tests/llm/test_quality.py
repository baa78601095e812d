from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from lethe.llm import quality
from lethe.llm.queries import QUERIES
from tests.llm.cases import awkward, awkward_rows, empty

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op10_quality"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_interactions_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype("f8")
    model = quality.fit_additive(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.scores(x[3000:]) > 0.5) == y[3000:]) > 0.95


def test_labels_of_one_kind_or_none():
    x = np.random.default_rng(0).random((10, len(quality.FEATURES)))
    assert quality.fit_additive(x[:0], np.zeros(0)).scores(x[:1]) == [0.5]
    assert np.allclose(quality.fit_additive(x, np.ones(10)).scores(x), 11 / 12)


def test_awkward_rows(spark):
    df = awkward(spark)
    features = quality.document_features(df)
    labels = spark.createDataFrame(
        [(0, 1), (0, 1), (1, 0), (2, None), (None, 1), (9, 0), (9, 1), (77, 0), (10, 0)], "doc_id long, quality int"
    )
    model = quality.fit_quality(features, labels, F.lit(True))
    rows = quality.score_quality(features, model).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in rows)
    none = quality.document_features(empty(spark))
    assert quality.score_quality(none, quality.fit_quality(none, labels, F.lit(True))).count() == 0


def test_a_hot_id_does_not_grow_the_sample(spark):
    hot = spark.range(2000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    features = quality.document_features(hot)
    assert quality.fit_quality(features, labels, F.lit(True)).base == np.log(2.0)
