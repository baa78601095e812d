from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from lethe.llm.exact_dedup import normalised
from tests.llm.cases import awkward, empty, saved
from tests.llm.test_mixing import level
from tests.llm.test_near_join import brute

SF_DIR = "/root/testdata/sf0.001"


def words():
    return F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))


def stages(spark, docs, folder):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        out[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = stages(spark, docs, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(got)
    for name in list(got)[:-1]:
        assert got[name].columns == docs.columns
    # All these texts have letters.
    assert got["language_id"].count() == docs.count()
    firsts = docs.groupBy(normalised(F.col("text"))).agg(F.min("doc_id").alias("doc_id"))
    kept = {r.doc_id for r in got["exact_dedup"].collect()}
    assert kept == {r.doc_id for r in firsts.collect()}
    rows = [(r.doc_id, r.text) for r in got["exact_dedup"].collect()]
    near = got["near_dedup"]
    assert {r.doc_id for r in near.collect()} == {c for _, c, _ in brute(rows)}
    sizes = {r.source: r.n for r in near.groupBy("source").agg(F.sum(words()).alias("n")).collect()}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    mixed = {r.source: r.n for r in got["mixing"].groupBy("source").agg(F.sum(words()).alias("n")).collect()}
    for source, target in level(sizes, weights).items():
        assert abs(mixed[source] - target) <= 0.5
    pieces = got["packing"]
    tokens = pieces.agg(F.sum("length")).head()[0]
    assert tokens > 0.97 * 1024 * pieces.select("sequence_id").distinct().count()
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in got["mixing"].collect()}


def test_awkward_and_empty_tables(spark, tmp_path):
    got = stages(spark, awkward(spark), tmp_path / "a")
    gone = awkward(spark).count() - got["language_id"].count()
    assert gone == 5  # without a letter or a text
    assert got["packing"].count() > 0
    assert stages(spark, empty(spark), tmp_path / "e")["packing"].count() == 0


def test_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).collect()
    path = saved(spark, [tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long", tmp_path)
    assert corpus_pipeline.run(spark, path).count() > 0
