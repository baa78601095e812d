from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lethe.llm.packing import LINEAR, QUADRATIC, pack_documents, place_pieces
from lethe.llm.queries import QUERIES
from lethe.llm.tokens import vocabulary_path
from tests.llm.cases import awkward, awkward_rows, empty

SF_DIR = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_every_token_lies_in_one_place(sizes):
    capacity = 64
    rows = list(place_pieces(np.array(sizes, "i8"), capacity))
    for doc, size in enumerate(sizes):
        own = sorted((s, n) for d, s, n, _, _ in rows if d == doc)
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) == size
    used = {}
    for _, _, n, seq, offset in rows:
        used.setdefault(seq, []).append((offset, n))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    assert len(used) * capacity - sum(sizes) < capacity


def test_costs_are_balanced():
    sizes = np.random.default_rng(0).integers(20, 500, 3000)
    cost = {}
    for _, _, n, seq, _ in place_pieces(sizes):
        cost[seq] = cost.get(seq, 0) + LINEAR * n + QUADRATIC * n * n
    values = np.array(list(cost.values()))
    # In the order given, first fit, they differ more.
    naive, at, total = [], 0, 0.0
    for n in sizes:
        if at + n > 1024:
            naive.append(total)
            at, total = 0, 0.0
        at, total = at + n, total + LINEAR * n + QUADRATIC * n * n
    assert values.std() < 0.5 * np.std(naive)


def check(rows, docs, end, capacity=1024):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    want = sorted(
        (doc_id is not None, doc_id or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, end])
        for doc_id, t in docs
    )
    got, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    # Pieces of rows that share an id are told apart by what they hold.
    for r in rows:
        got.setdefault((r.doc_id is not None, r.doc_id or 0), []).extend(r.ids)
    for key in {w[:2] for w in want}:
        ids = [i for w in want if w[:2] == key for i in w[2]]
        assert sorted(got[key]) == sorted(ids)
    return len(sequences) * capacity, sum(len(w[2]) for w in want)


def test_awkward_rows(spark):
    rows = pack_documents(awkward(spark), 0, with_ids=True).collect()
    check(rows, [r[:2] for r in awkward_rows()], 0)
    one = [r for r in rows if r.doc_id == 12]
    assert sum(r.length for r in one) == one[0].doc_tokens > 20 * 1024
    assert pack_documents(empty(spark), 0).count() == 0


@pytest.mark.parametrize("group", [3000, 1 << 21])
def test_whole_documents_come_back(spark, group):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = pack_documents(docs, 0, group_tokens=group, with_ids=True).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == len(by_doc.get(r.doc_id, []))
        by_doc.setdefault(r.doc_id, []).extend(r.ids)
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 0)


def test_query_pads_little(spark):
    rows = QUERIES["op8_packing"](spark, SF_DIR).collect()
    places = 1024 * len({r.sequence_id for r in rows})
    assert sum(r.length for r in rows) > 0.97 * places
