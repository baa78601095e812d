from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lethe.llm import common
from lethe.llm.common import with_row_key
from lethe.llm.exact_dedup import drop_copies
from lethe.llm.line_dedup import drop_repeated_lines
from lethe.llm.mixing import mix_sources, mixed_documents
from lethe.llm.near_join import drop_near_copies
from tests.llm.cases import prose

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, f"{prose(i, 30)}\n\nsame words in all of them\n\n{prose(100 + i, 30)}", "ab"[i % 2]) for i in range(20)]
    path = f"{tmp_path}/documents"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return path


def paragraphs(df):
    return df.select("doc_id", F.explode(F.split("text", "\n\n")).alias("text"), "source")


def shapes(spark, folder):
    df = spark.read.parquet(folder)
    twice = spark.range(3).withColumnRenamed("id", "n")
    file = df.inputFiles()[0]
    return {
        "explode": paragraphs(df),
        "join": df.join(twice),
        "union": df.unionByName(df),
        "path twice": spark.read.parquet(folder, folder),
        "file twice": spark.read.parquet(file, file),
        "repartition": df.repartition(5),
        "draw": df.where(F.rand() < 0.9),
    }


def test_keys_tell_rows_apart(spark, folder):
    for name, df in shapes(spark, folder).items():
        keyed = with_row_key(df, "k")
        keys = [r.k for r in keyed.collect()]
        assert len(set(keys)) == len(keys) > 0, name
        assert sorted(keys) == sorted(r.k for r in keyed.collect()), name
    assert with_row_key(paragraphs(spark.read.parquet(folder)), "k").count() == 60


def test_plain_scans_are_not_written(spark, folder, monkeypatch):
    monkeypatch.setattr(common, "written", lambda *a: pytest.fail("written"))
    df = spark.read.parquet(folder)
    for plain in (df, df.where("doc_id > 3"), df.select("doc_id", F.upper("text").alias("text"))):
        assert with_row_key(plain, "k").select("k").distinct().count() == plain.count()


def test_operators_on_paragraphs(spark, folder):
    df = paragraphs(spark.read.parquet(folder))
    texts = sorted({r.text for r in df.collect()})
    assert len(texts) == 41
    assert sorted(r.text for r in drop_copies(df).collect()) == texts
    assert sorted(r.text for r in drop_near_copies(df).collect()) == texts
    lines = [r.text for r in drop_repeated_lines(df).collect()]
    assert len(lines) == 60 and sorted(t for t in lines if t) == texts
    taken = mix_sources(df, (1, 1)).agg(F.sum("taken")).head()[0]
    words = F.size(F.split("text", "[\n ]+"))
    assert mixed_documents(df, (1, 1)).agg(F.sum(words)).head()[0] == taken


def test_other_inputs_are_written_once(spark, folder, monkeypatch):
    df = spark.read.parquet(folder).repartition(4)
    for module, operator in (("near_join", drop_near_copies), ("line_dedup", drop_repeated_lines)):
        labels = []
        real = common.written

        def spy(frame, label, *more, real=real, labels=labels):
            labels.append(label)
            return real(frame, label, *more)

        with monkeypatch.context() as patch:
            patch.setattr(common, "written", spy)
            operator(df).collect()
        assert labels.count("keyed") == 1, module
