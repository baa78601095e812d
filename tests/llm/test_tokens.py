from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lethe.llm.queries import QUERIES
from lethe.llm.token_files import (
    new_token_dir,
    read_digests,
    read_positions,
    read_token_files,
    write_token_files,
)
from lethe.llm.tokens import PieceEncoder, encoder, vocabulary_path
from tests.llm.cases import awkward, awkward_rows, empty

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t  \x1cab'stéßZ.,!1٣日", max_size=30))
def test_pieces_give_the_ids_of_the_whole(whole, text):
    assert encoder(vocabulary_path()).encode(text).tolist() == whole(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "  a", "a  b", " a b ", "a \n\n b\t c", "don't  you'll", "<|endoftext|> x", "日本 語 a1 2b", "a" * 3000],
)
def test_literal_texts(whole, text):
    assert encoder(vocabulary_path()).encode(text).tolist() == whole(text)


def test_full_caches_change_nothing(whole):
    small = PieceEncoder(vocabulary_path(), capacity=5)
    words = ["ab", "cde", "fg,", "éé", "x1", "zz!", "the", "of", "and", "q"]
    rng = random.Random(0)
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(20))
        assert small.encode(text).tolist() == whole(text)
    assert len(small.young) <= 5 and len(small.old) <= 5


def expected(rows, whole, end):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole(text), end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_round_trip(spark, whole):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = QUERIES["op5_token_files"](spark, SF_DIR).collect()
    assert sorted(tuple(r) for r in rows) == expected(docs, whole, 2)


def test_awkward_rows(spark, whole):
    path = new_token_dir(spark)
    write_token_files(awkward(spark), path, end_id=2)
    rows = sorted(read_digests(spark, path).collect(), key=lambda r: r.start)
    want = expected([r[:2] for r in awkward_rows()], whole, 2)
    # Rows that share an id may stand in either order.
    assert [r.doc_id for r in rows] == [w[0] for w in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (w[0] is not None, w[0] or 0, *w[2:]) for w in want
    )
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    places = {(r.start, r.n_tokens) for r in read_positions(spark, path).collect()}
    assert places == {(r.start, r.n_tokens) for r in rows}


def test_layout_and_selective_reads(spark):
    path = new_token_dir(spark)
    write_token_files(spark.read.parquet(f"{SF_DIR}/documents.parquet"), path, end_id=2)
    files = [f for f in spark.read.parquet(path).inputFiles()]
    group = pq.ParquetFile(files[0].removeprefix("file://")).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and ids.has_offset_index
    plan = read_token_files(spark, path).where("doc_id = 5").select("n_tokens")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in text
    assert "ids" not in text.split("ReadSchema")[1]


def test_empty_table(spark):
    path = new_token_dir(spark)
    write_token_files(empty(spark), path, end_id=2)
    assert read_digests(spark, path).count() == 0
