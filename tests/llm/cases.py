"""Small tables with everything that is awkward, and helpers to compare with brute force."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row_key string, "
    "part int, size int, score string, LANG_PRED string, `set` int, `first` int, id int, taken int"
)
EXTRA = ("k", 1, 2, "s", "p", 3, 4, 5, 6)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choice(["an", "er", "th", "on", "re", "st"]) for _ in range(rng.randint(1, 5))) for _ in range(words)]
    return " ".join(made)


def awkward_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [
        (0, base, "en", "a"),
        (1, near, "en", "a"),
        (2, base, "de", "b"),
        (2, base, "de", "b"),  # a repeated row
        (3, None, None, None),
        (4, "", "fr", "b"),
        (5, " \t\r\n ", None, "c"),
        (6, "one", "en", None),
        (7, base.replace(" ", "  "), "en", "a"),  # equal but for white space
        (None, base, "en", "a"),
        (None, None, None, "d"),
        (8, "日本語 テキスト ééé ßß <|endoftext|> don't", "es", "é"),
        (9, "line one here\nline one here\n\nother line\nline one here", "en", "a"),
        (10, "!!! ??? 123", "en", "a"),
        (11, "x" * 5000, "de", "c"),
        (12, " ".join([base] * 300), "fr", "c"),  # very long
        (13, prose(2, 3), "es", "a"),
        (5, "same id, other text", "en", "c"),
    ]
    texts += [(20 + i, "copy of one text", "en", "hot") for i in range(40)]
    return [(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in texts]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def saved(spark: SparkSession, rows: list[tuple], schema: str, folder, name: str = "documents") -> str:
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
