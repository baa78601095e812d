"""Periodic runs of words inside texts: passages that repeat themselves back to back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lethe.llm.common import free_name, prepare_workers
from lethe.llm.suffix_tree import all_runs

MIN_LENGTH, MIN_PERIODS = 24, 3
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def repeated_regions(codes: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int]]:
    """Ascending, disjoint parts of a sequence outside which no run lies.

    In a run of period q, length - q places in a row equal the place q later, and so do all
    grams of half the least number of such places. So a run lies behind a stretch of places
    whose gram comes again, and the length of that stretch bounds q. Grams are compared by a
    hash: a collision makes a region larger, never smaller.
    """
    equal = -(-min_length * (min_periods - 1) // min_periods)
    size = max(equal // 2, 1)
    n = len(codes) - size + 1
    if len(codes) < min_length or n < 1:
        return []
    grams = np.zeros(n, "u8")
    mixed = (codes.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for k in range(size):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(grams, kind="stable")
    inside = grams[order]
    again = np.zeros(n + 2, "i1")
    again[1 + order[:-1][inside[1:] == inside[:-1]]] = 1
    edges = np.diff(again)
    first, behind = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    stretch = behind - first
    long = stretch >= equal - size + 1
    regions: list[tuple[int, int]] = []
    for a, b, s in zip(first[long], behind[long], stretch[long], strict=True):
        period = (int(s) + size - 1) // (min_periods - 1)
        low, high = max(int(a) - 1, 0), min(int(b) + period + size + 1, len(codes))
        if regions and low <= regions[-1][1]:
            regions[-1] = regions[-1][0], max(high, regions[-1][1])
        else:
            regions.append((low, high))
    return regions


def runs_of_words(words: Sequence[bytes], min_length: int, min_periods: int) -> np.ndarray:
    """Rows ``start, length, period``, by start and period."""
    if len(words) < min_length:
        return np.zeros((0, 3), "i8")
    known: dict[bytes, int] = {}
    for word in words:
        known.setdefault(word, len(known))
    codes = np.fromiter(map(known.__getitem__, words), "i8", len(words))
    found = [np.zeros((0, 3), "i8")]
    for low, high in repeated_regions(codes, min_length, min_periods):
        runs = all_runs(codes[low:high].tolist(), min_length, min_periods)
        runs[:, 0] += low
        found.append(runs)
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words joined by one space, without those that a run only repeats."""
    if len(runs):
        change = np.zeros(len(words) + 1, "i8")
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
        words = [words[i] for i in kept]
    return b" ".join(words)


def _struct_array(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros((0, 3), "i8")
    ends = np.cumsum([0, *map(len, rows)])
    names = ["start", "length", "period"]
    values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def find_runs(
    df: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    min_length: int = MIN_LENGTH,
    min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """The kept columns, ``n_words``, ``runs`` and ``collapsed`` of every row.

    Words are what white space separates. ``runs`` lists by start and period every stretch of
    consecutive words with smallest period ``period``, at least ``min_length`` words and
    ``min_periods`` periods long, that no neighbouring word extends. ``collapsed`` is the text
    without the words that stand in a run after its first period, joined by single spaces.

    Each row is worked on by itself, in one scan without a shuffle, so ties and repeated rows
    do not matter. Memory follows the longest repetitive part of a text, not the text. A null
    or empty text has no words, no runs and an empty ``collapsed``. An empty table gives none.
    A kept column may have the name of a new one, which then gets an underscore.
    """
    spark = df.sparkSession
    prepare_workers(spark)
    names = [free_name(n, keep) for n in ("n_words", "runs", "collapsed")]
    text = free_name("text", keep)
    source = df.select(*keep, F.col(text_col).alias(text))
    schema = T.StructType([*source.schema.fields[:-1]])
    for name, kind in zip(names, (T.LongType(), T.ArrayType(RUN), T.StringType()), strict=True):
        schema = schema.add(name, kind)
    list_type = to_arrow_type(schema[names[1]].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for value in batch.column(batch.num_columns - 1):
                words = (value.as_py() or "").encode().split()
                found = runs_of_words(words, min_length, min_periods)
                counts.append(len(words))
                runs.append(found)
                texts.append(collapse(words, found).decode())
            made = [pa.array(counts, pa.int64()), _struct_array(runs).cast(list_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *names]
            )

    return source.mapInArrow(work, schema)


def densest(runs: Column) -> Column:
    """The run that repeats most often, by the exact ratio of length and period; of equal ones
    the first of the array. Null if there is none."""
    return F.aggregate(
        runs,
        F.lit(None).cast(RUN),
        lambda best, run: F.when(
            best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
        ).otherwise(best),
    )
