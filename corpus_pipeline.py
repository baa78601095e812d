"""Documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import exact_dedup, language_id, mixing, near_join, packing
from lethe.llm.common import scratch, table, written

WEIGHTS = (5, 2, 1)
END_ID = 0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, but for those without a text, or without a letter in it.

    The model learns from the labelled documents that came in, less a fold kept for tests.
    ``lang`` is what the text was found to be in. If there is no labelled document to learn
    from, there is no model, and ``lang`` stays as it is.
    """
    lettered = docs.where(F.coalesce(docs["text"].rlike(language_id.LETTER), F.lit(False)))
    usable = docs["doc_id"].isNotNull() & ~language_id.in_fold("doc_id", 4, 2)
    model = language_id.fit_languages(docs, usable)
    if not model.families:
        return lettered
    found = language_id.predict_languages(lettered, model, docs.columns)
    return found.withColumn("lang", found[language_id.LANGUAGE]).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return near_join.drop_near_copies(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: a document stands as often as it is taken whole, and once more with
    the words up to its source's cut."""
    return mixing.mixed_documents(docs, WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.pack_documents(docs, END_ID, with_ids=True, special_tokens=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

# A trained classifier and a tokenizer library are not SQL; tests/llm/test_pipeline.py
# compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next.

    When a stage's result is written, what was written before it is deleted.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark, keep_last=True):
            docs = written(stage(spark, docs, sf_dir), name)
    return docs
