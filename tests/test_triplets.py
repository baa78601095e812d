from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lethe import schemas
from lethe.options import EngineOptions
from lethe.operators import embed, triplets
from lethe.session import materialise, ship_package

DOC = "doc_id string, text string"


def extract(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], DOC)
    rows = triplets.extract_triplets(df).orderBy("doc_id").collect()
    return [[tuple(t) for t in row.triplets] for row in rows]


def test_plain_sentences(spark):
    assert extract(
        spark,
        "Alice developed the algorithm.",
        "Bob wrote the code. Carol verified the proof.",
        "Engine computes shards",
        "Alice is an engineer.",
    ) == [
        [("Alice", "DEVELOP", "algorithm")],
        [("Bob", "WRITE", "code"), ("Carol", "VERIFY", "proof")],
        [("Engine", "COMPUTE", "shards")],
        [("Alice", "BE", "engineer")],
    ]


def test_blank_and_fallbacks(spark):
    long = "Cryptography  " + "x" * 40
    assert extract(spark, "", " \n\t ", None, "the of and", "Cryptography", long) == [
        [],
        [],
        [],
        [],
        [("Cryptography", "ASSOCIATED_WITH", "Cryptography")],
        [("Cryptography", "ASSOCIATED_WITH", "Cryptography  " + "x" * 16)],
    ]


def token(text, pos="NOUN", dep="", lemma=None):
    return (text, lemma or text.lower(), pos, dep)


SUBJ, OBJ = ("NOUN", "nsubj"), ("NOUN", "dobj")
CASES = {
    "svo": [[token("A", *SUBJ), token("sees", "VERB", "ROOT", "see"), token("B", *OBJ)]],
    "copula": [[token("A", *SUBJ), token("is", "AUX", "ROOT", "be"), token("B", "NOUN", "attr")]],
    "object first": [[token("B", *OBJ), token("A", *SUBJ), token("s", "VERB", "ROOT", "see")]],
    "overwritten": [
        [token("A", *SUBJ), token("C", *SUBJ), token("s", "VERB", "", "see"), token("B", *OBJ)]
    ],
    "two in one": [
        [
            token("A", *SUBJ),
            token("s", "VERB", "", "see"),
            token("B", *OBJ),
            token("D", "NOUN", "nsubjpass"),
            token("h", "VERB", "", "hear"),
            token("E", "NOUN", "oprd"),
        ]
    ],
    "reset": [
        [token("A", *SUBJ), token("s", "VERB", "", "see")],
        [token("B", *OBJ), token("C", *SUBJ)],
    ],
    "verb as subject": [[token("A", "VERB", "csubj"), token("B", *OBJ), token("s", "VERB")]],
    "noun verb noun": [[token("A")], [token("s", "VERB", "", "see")], [token("B", "PROPN")]],
    "one noun": [[token("s", "VERB", "", "see")], [token("A")]],
    "none": [[token("s", "VERB", "", "see"), token("of", "ADP")]],
}


def model(sentences, text):
    """The fold, one token at a time."""
    out = []
    for sentence in sentences:
        held = {"s": "", "p": "", "o": ""}
        for word, lemma, pos, dep in sentence:
            if "subj" in dep:
                held["s"] = word
            elif pos in ("VERB", "AUX"):
                held["p"] = lemma
            elif any(d in dep for d in ("obj", "attr", "oprd")):
                held["o"] = word
            if all(held.values()):
                out.append((held["s"], held["p"].upper(), held["o"]))
                held = dict.fromkeys(held, "")
    flat = [t for s in sentences for t in s]
    nouns = [t[0] for t in flat if t[2] in ("NOUN", "PROPN")]
    verbs = [t[1] for t in flat if t[2] in ("VERB", "AUX")]
    if not out and len(nouns) >= 2 and verbs:
        out = [(nouns[0], verbs[0].upper(), nouns[1])]
    elif not out and nouns:
        out = [(nouns[0], "ASSOCIATED_WITH", text[:30].strip())]
    return out


def random_sentences(rng):
    tags = [SUBJ, OBJ, ("VERB", "ROOT"), ("AUX", "aux"), ("NOUN", ""), ("ADP", "prep")]
    tags += [("PROPN", "attr"), ("VERB", "csubj"), ("VERB", "xobj")]
    return [
        [token(f"w{rng.randrange(9)}", *rng.choice(tags)) for _ in range(rng.randrange(7))]
        for _ in range(rng.randrange(5))
    ]


def test_token_tables(spark):
    rng = random.Random(3)
    docs = {name: sentences for name, sentences in CASES.items()}
    docs |= {f"random {i}": random_sentences(rng) for i in range(150)}
    rows = [
        (name, s, t, *tok)
        for name, sentences in docs.items()
        for s, sentence in enumerate(sentences)
        for t, tok in enumerate(sentence)
    ]
    rng.shuffle(rows)
    tokens = spark.createDataFrame(rows, schemas.TOKEN_TABLE)
    texts = {name: f"text of {name} " + "y" * 30 for name in docs}
    documents = spark.createDataFrame(list(texts.items()), DOC)
    found: dict[str, list] = {name: [] for name in docs}
    result = triplets.triplets_from_tokens(tokens, documents)
    for r in result.orderBy("doc_id", "sent_id", "n").collect():
        found[r.doc_id].append((r.subject, r.predicate, r.object))
    assert found == {name: model(docs[name], texts[name]) for name in docs}


def test_pluggable_annotator(spark):
    def annotate(text):
        word = F.struct(
            F.lit(0).alias("tok_id"),
            text.alias("text"),
            F.lower(text).alias("lemma"),
            F.lit("PROPN").alias("pos"),
            F.lit("").alias("dep"),
        )
        return F.array(F.array(word))

    df = spark.createDataFrame([("1", "whole text")], DOC)
    row = triplets.extract_triplets(df, annotate).first()
    assert [tuple(t) for t in row.triplets] == [("whole text", "ASSOCIATED_WITH", "whole text")]


def test_embedding(spark):
    texts = ["Alice wrote code", "alice WROTE code", "", " \u001c", None, "other words here"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], DOC)
    out = embed.embed_documents(df, embed.hashing_encoder(384)).orderBy("doc_id").collect()
    assert [r.message is None for r in out] == [True, True, False, False, False, True]
    assert all(len(r.vector) == 384 for r in out if r.message is None)
    assert sum(x * x for x in out[0].vector) == pytest.approx(1, abs=1e-3)
    assert out[0].vector == out[1].vector != out[5].vector
    assert out[2].vector is None and out[2].message == "Input text cannot be empty."


def test_batch_encoder_sees_small_batches(spark):
    ship_package(spark)

    def load():
        def model(texts):
            assert len(texts) <= 3
            return [[float(len(t)), float(len(texts))] for t in texts]

        return model

    df = spark.createDataFrame([(str(i), "x" * (i + 1)) for i in range(10)], DOC).coalesce(1)
    out = embed.embed_documents(df, embed.batch_encoder(load, EngineOptions(encode_batch=3))).collect()
    assert sorted(r.vector[0] for r in out) == [float(i + 1) for i in range(10)]


def test_embed_and_extract_batch(spark):
    rows = [
        ("a", 1, "doc_1", "user_101", "Alice developed code."),
        ("a", 2, "doc_2", "user_102", "Bob wrote code."),
        ("b", 3, "doc_3", "user_101", "Carol wrote code."),
        ("b", 4, "doc_empty", "user_101", "  "),
    ]
    items = spark.createDataFrame(
        rows, "batch_id string, seq long, id string, entity_id string, text string"
    )
    out = embed.embed_and_extract_batch(items, embed.hashing_encoder(8)).collect()
    assert {(r.id, len(r.vector), len(r.triplets)) for r in out} == {
        ("doc_1", 8, 1),
        ("doc_2", 8, 1),
    }
    assert embed.embed_and_extract_batch(items.limit(0), embed.hashing_encoder(8)).count() == 0


def same_tokens(spark, rows, texts):
    tokens = spark.createDataFrame(rows, schemas.TOKEN_TABLE).coalesce(2)
    documents = spark.createDataFrame(list(texts.items()), DOC)
    out = triplets.triplets_from_tokens(tokens, documents).collect()
    return Counter(tuple(r) for r in out)


def test_order_repeats_and_nulls_of_token_rows(spark):
    rng = random.Random(5)
    docs = [f"d{i}" for i in range(80)]
    rows = [
        (doc, s, t, *tok)
        for doc in docs
        for s, sentence in enumerate(random_sentences(rng))
        for t, tok in enumerate(sentence)
    ]
    rows += rng.sample(rows, 60)
    rows += [(d, s, t, f"{x}2", *more) for d, s, t, x, *more in rng.sample(rows, 60)]
    rows += [(d, None, t, *more) for d, _, t, *more in rng.sample(rows, 30)]
    rows += [(d, s, None, *more) for d, s, _, *more in rng.sample(rows, 30)]
    rows += [(None, s, t, *more) for _, s, t, *more in rng.sample(rows, 30)]
    texts = {doc: f"text of {doc}" for doc in docs}
    ordered = same_tokens(spark, sorted(rows, key=str), texts)
    assert any(r[1] == -1 for r in ordered) and any(r[0] is None for r in ordered)
    for _ in range(2):
        rng.shuffle(rows)
        assert same_tokens(spark, rows, texts) == ordered


def test_neighbouring_tokens_travel_as_one_row(spark, monkeypatch):
    """A sentence is put together where it is read: no token is sorted or shuffled alone."""
    plans = []

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, label)

    monkeypatch.setattr(triplets, "materialise", seen)
    rows = [
        ("a", 0, 0, *token("A", *SUBJ)),
        ("a", 0, 1, *token("s", "VERB", "", "see")),
        ("a", 0, 2, *token("B", *OBJ)),
    ]
    assert same_tokens(spark, rows, {"a": "text"}) == {("a", 0, 0, "A", "SEE", "B"): 1}
    before = plans[0].split("Exchange hashpartitioning")
    assert len(before) == 2 and "Aggregate" not in before[1] and "MapInArrow" in before[1]


def test_sentence_runs():
    """Nouns without a role after the second one of a document stay behind."""
    n = ("NOUN", "dep")
    rows = [(d, s, t, *token(f"{d}{s}{t}", *n), True, False) for d in "ab" for s in (0, 1) for t in (0, 1, 2)]
    rows[4] = ("a", 1, 1, *token("verb", "VERB", "ROOT"), False, True)
    names = ["doc_id", "sent_id", "tok_id", "text", "lemma", "pos", "dep", "noun", "read"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    out = [r for b in triplets._sentence_runs([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert [(r["doc_id"], r["sent_id"], [t["text"] for t in r["tokens"]]) for r in out] == [
        ("a", 0, ["a00", "a01"]),
        ("a", 1, ["verb"]),
        ("b", 0, ["b00", "b01"]),
    ]
