from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lethe.llm.language_id import in_fold
from tests.llm.cases import awkward, awkward_rows

LETTERED = sorted(
    ((r[0] is None, r[0] or 0), r[1]) for r in awkward_rows() if any(c.isalpha() for c in r[1] or "")
)

LABELS = {
    "no label": lambda: F.lit(None).cast("string"),
    "held-out labels only": lambda: F.when(in_fold("doc_id", 4, 2), F.col("lang")),
    "labelled und": lambda: F.lit("und"),
}


@pytest.mark.parametrize("case", LABELS)
def test_texts_with_letters_stay_whatever_the_labels(spark, case):
    docs = awkward(spark).withColumn("lang", LABELS[case]())
    got = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text) for r in got) == LETTERED
    labels = {(r.doc_id, r.text, r.lang) for r in docs.collect()}
    assert {(r.doc_id, r.text, r.lang) for r in got} <= labels


def test_run_without_labels(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs.withColumn("lang", LABELS["no label"]()).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
