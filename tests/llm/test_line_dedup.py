from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lethe.llm.line_dedup import drop_repeated_lines, find_repeated_lines, word_rarity
from lethe.llm.queries import QUERIES, SQL
from tests.llm.cases import awkward, awkward_rows, empty
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


def words(line):
    for c in "\t\r\x0b\x0c":
        line = line.replace(c, " ")
    return {w for w in line.split(" ") if w}


def brute(rows, similarity=0.8):
    lines = []
    for at, (doc_id, text) in enumerate(rows):
        for n, line in enumerate([] if text is None else text.split("\n")):
            lines.append(((doc_id is None, doc_id or 0), at, n, words(line)))
    gone = {}
    for key, at, n, own in lines:
        for other, at2, n2, before in lines:
            if own and before and (other, at2 if other == key else 0, n2) < (key, at if other == key else 0, n):
                if len(own & before) / len(own | before) >= similarity:
                    gone.setdefault(at, []).append(n)
                    break
    return [gone.get(at, []) for at in range(len(rows))]


def test_query_against_sql(spark):
    name = "op3_line_dedup"
    assert difference(spark, connect(SF_DIR), SF_DIR, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_against_all_pairs(spark, similarity):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lines = [
            " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 2) for _ in range(rng.randint(0, 12)))
            for _ in range(rng.randint(0, 6))
        ]
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = find_repeated_lines(df, similarity=similarity).orderBy("doc_id").collect()
    assert [r.removed for r in got] == brute(rows, similarity)
    assert [r.n_lines for r in got] == [len(t.split("\n")) for _, t in rows]


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = find_repeated_lines(df).collect()
    assert len(rows) == len(awkward_rows())
    removed = sum(len(r.removed) for r in rows)
    assert removed == sum(map(len, brute([r[:2] for r in awkward_rows()])))
    assert [r.removed for r in rows if r.doc_id == 9] == [[1, 4]]
    assert [r.n_lines for r in rows if r.doc_id == 3] == [0]
    out = drop_repeated_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("doc_id = 9").head().text == "line one here\n\nother line"
    assert find_repeated_lines(empty(spark)).count() == 0


def test_plan_has_no_python(spark):
    df = find_repeated_lines(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_rarity_counts_all_words(spark):
    df = spark.createDataFrame([("a a a a b",), (None,), ("",)], "text string")
    assert sorted(word_rarity(df.select(F.col("text"))))[-1] == 2
