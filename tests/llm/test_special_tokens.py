from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from lethe.llm.queries import QUERIES
from lethe.llm.tokens import encoder, vocabulary_path
from tests.llm.cases import saved

NAME = "<|endoftext|>"
TEXTS = [f"x {NAME} y", f"x    {NAME}", f"{NAME}{NAME}\n {NAME}  y", "<|endoftext", None, "plain words"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([NAME, NAME[:5], " ", "  ", "\n", "\t", "ab", "é", ".", "   "]), max_size=12))
def test_pieces_give_the_ids_of_the_plain_call(plain, parts):
    text = "".join(parts)
    assert encoder(vocabulary_path(), special_tokens=True).encode(text).tolist() == plain(text)


def test_queries_and_packing_stage_follow_the_plain_call(spark, plain, tmp_path):
    assert plain(TEXTS[0]) == [87, 220, 50256, 331]
    path = saved(spark, list(enumerate(TEXTS)), "doc_id long, text string", tmp_path)
    want = {}
    for end in (0, 2):
        ids = [np.array([*plain(t), end], "<u4").tobytes() for t in TEXTS]
        want[end] = {(i, len(b) // 4, zlib.crc32(b)) for i, b in enumerate(ids)}
    files = QUERIES["op5_token_files"](spark, path).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in files} == want[2]
    pieces = QUERIES["op8_packing"](spark, path).collect()
    assert {(r.doc_id, r.length, r.ids_crc32) for r in pieces} == want[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    staged = corpus_pipeline.pack_sequences(spark, docs, path).collect()
    assert {(r.doc_id, r.length, r.ids_crc32) for r in staged} == want[0]
