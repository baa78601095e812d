from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from lethe.llm import language_id
from lethe.llm.language_id import fit_languages, group_families, in_fold, predict_languages
from lethe.llm.queries import QUERIES
from tests.llm.cases import awkward, awkward_rows, empty

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {i for i, r in rows.items() if r.held_out}
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_only_the_text_counts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = fit_languages(docs, ~in_fold("doc_id", 4, 2), per_language=50)
    plain = predict_languages(docs, model, ["doc_id"])
    turned = predict_languages(
        docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), model, ["doc_id"]
    )
    assert sorted(plain.collect()) == sorted(turned.collect())
    again = fit_languages(docs.repartition(7), ~in_fold("doc_id", 4, 2), per_language=50)
    assert np.array_equal(model.weights, again.weights)


def test_sample_is_bounded(spark, monkeypatch):
    seen = []

    class Spy(language_id.LanguageModel):
        def __init__(self, x, lang):
            seen.append(dict(zip(*np.unique(lang.astype(str), return_counts=True), strict=True)))
            super().__init__(x, lang)

    monkeypatch.setattr(language_id, "LanguageModel", Spy)
    hot = spark.range(3000).select(
        F.lit(1).alias("doc_id"), F.lit("der Text und das").alias("text"), F.lit("de").alias("lang")
    )
    fit_languages(hot, F.lit(True), per_language=20)
    assert max(seen[0].values(), default=0) <= 20


def test_families_join_the_closest():
    means = np.array([[1, 0.1, 0], [0, 0, 1.0], [1, 0, 0.1], [0.1, 0.1, 1]])
    assert sorted(group_families(["a", "b", "c", "d"], means)) == [["a", "c"], ["b", "d"]]
    assert group_families(["a"], means[:1]) == [["a"]]


def test_awkward_rows(spark):
    df = awkward(spark)
    model = fit_languages(df, F.col("doc_id").isNotNull())
    rows = predict_languages(df, model, df.columns).collect()
    assert len(rows) == len(awkward_rows())
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "de", "fr", "es"} and 0 <= r.score <= 1
    nothing = fit_languages(empty(spark), F.lit(True))
    assert {r.lang_pred for r in predict_languages(df, nothing, ["doc_id"]).collect()} == {"und"}
    assert predict_languages(empty(spark), model, ["doc_id"]).count() == 0
