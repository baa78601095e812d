"""Text to unit vectors as a batch inference job with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe import messages
from lethe.functions.text import has_content
from lethe.operators.triplets import extract_triplets
from lethe.operators.validate import accepted, embed_batch_verdicts
from lethe.options import EngineOptions

# An encoder adds a vector column: (rows, text column, output column) -> rows.
Encoder = Callable[[DataFrame, str, str], DataFrame]
BatchModel = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashing_encoder(dimension: int) -> Encoder:
    """Normalised hashed term counts, computed in the JVM; needs no model and no fitting."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        words = Tokenizer(inputCol=text, outputCol="_words").transform(df)
        counts = HashingTF(
            inputCol="_words", outputCol="_counts", numFeatures=dimension
        ).transform(words)
        unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counts)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop(
            "_words", "_counts", "_unit"
        )

    return encode


def batch_encoder(load: Callable[[], BatchModel], options: EngineOptions) -> Encoder:
    """A Python model that gets ``options.encode_batch`` texts at a time. ``load`` is called
    once per Python worker; only the text column goes there."""

    def make_predict():
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(model(texts.tolist()), "f4").reshape(len(texts), -1)

        return predict

    infer = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=options.encode_batch
    )

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, infer(F.col(text)))

    return encode


def embed_documents(documents: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Adds ``vector`` and ``message``: blank text has no vector but the error message."""
    filled = documents.withColumn(
        "_text", F.when(has_content(F.col(text)), F.col(text)).otherwise(F.lit("-"))
    )
    encoded = encoder(filled, "_text", "vector").drop("_text")
    ok: Column = has_content(F.col(text))
    return encoded.withColumn("vector", F.when(ok, F.col("vector"))).withColumn(
        "message", F.when(~ok, F.lit(messages.EMBED_BLANK))
    )


def embed_and_extract_batch(items: DataFrame, encoder: Encoder, **extract) -> DataFrame:
    """Vector and triplets per item (batch_id, seq, id, entity_id, text), for the batches
    without blank text; one pass over the texts."""
    good = accepted(items, embed_batch_verdicts(items))
    return embed_documents(extract_triplets(good, **extract), encoder).drop("message")
