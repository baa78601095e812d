"""Exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import prepare_workers, row_number_in_task, written

BLOCK_ROWS = 4096  # candidates of one vertical block
QUERY_ROWS = 256  # queries met by a block at once
DIMS = 8  # dimensions added between two prunings

# Products and sums up to here are exact in double arithmetic.
EXACT = 1 << 53

BLOCK_SCHEMA = "rows binary, ids binary, width int, cells binary"
BLOCK_ARROW = pa.schema(
    [
        ("rows", pa.binary()),
        ("ids", pa.binary()),
        ("width", pa.int32()),
        ("cells", pa.binary()),
    ]
)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``row, vec_id, v``: each component as ``floor(scale * x)``, of the rows that take part."""
    bad = F.exists(
        F.col("v"),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return (
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vector_col).cast("array<double>").alias("v"),
            row_number_in_task().alias("row"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
        .select("row", "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    )


def _pack(rows: np.ndarray, ids: np.ndarray, lists: pa.ListArray) -> dict:
    """One vertical block: dimension after dimension, missing tail components as zero."""
    lengths = np.diff(lists.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    cells = np.zeros((width, len(ids)), "<i8")
    owner = np.repeat(np.arange(len(ids)), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    cells[np.arange(len(flat)) - starts, owner] = flat
    return {
        "rows": rows.astype("<i8").tobytes(),
        "ids": ids.astype("<i8").tobytes(),
        "width": width,
        "cells": cells.tobytes(),
    }


def _as_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the task as one block."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts).combine_chunks()
    lists = whole.column("v").combine_chunks()
    packed = _pack(whole.column("row").to_numpy(), whole.column("vec_id").to_numpy(), lists)
    yield pa.RecordBatch.from_pylist([packed], BLOCK_ARROW)


class Block:
    """Candidates laid out by dimension, with the mass that remains from each pruning on."""

    def __init__(self, rows: bytes, ids: bytes, width: int, cells: bytes):
        self.rows = np.frombuffer(rows, "<i8")
        self.ids = np.frombuffer(ids, "<i8")
        self.cells = np.frombuffer(cells, "<i8").reshape(width, len(self.ids))
        # Negating the smallest integer overflows, so the largest size is taken from both ends.
        low, high = int(self.cells.min(initial=0)), int(self.cells.max(initial=0))
        self.largest = max(-low, high)
        self.width = width


def remaining_mass(cells: np.ndarray) -> np.ndarray:
    """Per pruning step and column, the norm of the dimensions not yet added."""
    steps = -(-len(cells) // DIMS)
    squares = np.zeros((steps + 1, cells.shape[1]))
    for s in range(steps - 1, -1, -1):
        part = cells[s * DIMS : (s + 1) * DIMS].astype("f8")
        squares[s] = squares[s + 1] + (part * part).sum(axis=0)
    return np.sqrt(squares)


def best_of_block(
    queries: Block, candidates: Block, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query, position and score of all candidates that can be among its best ``k``.

    Scores are added up ``DIMS`` dimensions at a time. After each step no candidate can gain
    or lose more than the product of what remains of its mass and the query's (Cauchy and
    Schwarz). Those that cannot reach the ``k``-th best guaranteed score are dropped and the
    others moved together; ties stay.
    """
    width = min(queries.width, candidates.width)
    left = candidates.cells[:width]
    right = queries.cells[:width]
    if max(width, 1) * candidates.largest * queries.largest >= EXACT:
        # Sums may leave exact doubles: add all in 64-bit integers, which wrap around.
        for q in range(len(queries.ids)):
            yield q, np.arange(len(candidates.ids)), (left * right[:, q : q + 1]).sum(axis=0)
        return
    left, right = left.astype("f8"), right.astype("f8")
    mass, query_mass = remaining_mass(left), remaining_mass(right)
    head = right[:DIMS].T @ left[:DIMS] if width else np.zeros((len(queries.ids), len(candidates.ids)))
    for q in range(len(queries.ids)):
        score = head[q]
        alive = None  # positions, once some were dropped
        for step in range(1, mass.shape[0]):
            reach = mass[step] if alive is None else mass[step][alive]
            reach = reach * query_mass[step, q]
            # Half a unit covers the rounding of norms; scores are whole numbers.
            if len(score) <= k:
                keep = np.arange(len(score))
            else:
                sure = score - reach
                bound = np.partition(sure, len(sure) - k)[len(sure) - k] - 0.5
                keep = np.flatnonzero(score + reach + 0.5 >= bound)
            if len(keep) < len(score):
                alive = keep if alive is None else alive[keep]
                score = score[keep]
            if step * DIMS < width and len(score):
                rows = slice(step * DIMS, (step + 1) * DIMS)
                part = left[rows] if alive is None else left[rows][:, alive]
                score = score + right[rows, q] @ part
        where = np.arange(len(candidates.ids)) if alive is None else alive
        yield q, where, score.astype("i8")


def _search(k: int):
    schema = pa.schema(
        [
            ("query_row", pa.int64()),
            ("query_id", pa.int64()),
            ("vec_id", pa.int64()),
            ("row", pa.int64()),
            ("score", pa.int64()),
        ]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                queries = Block(pair["q_rows"], pair["q_ids"], pair["q_width"], pair["q_cells"])
                candidates = Block(pair["rows"], pair["ids"], pair["width"], pair["cells"])
                found: list[list[np.ndarray]] = [[], [], [], [], []]
                # One more than asked for: the query itself may be among them.
                for q, where, score in best_of_block(queries, candidates, k + 1):
                    other = candidates.rows[where] != queries.rows[q]
                    where, score = where[other], score[other]
                    order = np.lexsort((candidates.rows[where], candidates.ids[where], -score))[:k]
                    where, score = where[order], score[order]
                    n = len(where)
                    for column, values in zip(
                        found,
                        (
                            np.full(n, queries.rows[q]),
                            np.full(n, queries.ids[q]),
                            candidates.ids[where],
                            candidates.rows[where],
                            score,
                        ),
                        strict=True,
                    ):
                        column.append(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), pa.int64()) for c in found], schema=schema
                )

    return search


def _written_blocks(vectors: DataFrame, rows: int, label: str) -> DataFrame:
    """Blocks of about ``rows`` rows each."""
    n = max(1, -(-vectors.count() // rows))
    return written(vectors.repartition(n).mapInArrow(_as_block, BLOCK_SCHEMA), label)


def _pairs(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Each candidate block beside each query block, whose columns begin with ``q_``.

    A product by pairs of partitions: each task reads the blocks of both sides from where they
    were written, so nothing is copied, shuffled or broadcast. The optimizer takes one side for
    small by its compressed files, and would collect it on the driver. A task holds the query
    blocks of its partition.
    """
    named = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    return blocks.crossJoin(named.hint("shuffle_replicate_nl"))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` best inner products of every query row with the other rows of ``vectors``.

    Both hold ``row, vec_id, v`` with whole numbers; ``queries`` is a subset of ``vectors``,
    told apart by ``row``. Returns ``query_row, query_id, rank, vec_id, score``; ties go to
    the smaller id, then to the earlier row.

    Rows become vertical blocks, each query block meets each candidate block once, and a pair
    of blocks gives at most ``k`` rows per query. Block sizes bound the memory of a task. A
    vector shorter than another counts as filled up with zeros, an empty one scores 0. Scores
    beyond 64 bits wrap around, as they do in SQL without ANSI checks.
    """
    blocks = _written_blocks(vectors, block_rows, "blocks")
    asked = _written_blocks(queries, query_rows, "queries")
    found = _pairs(blocks, asked).mapInArrow(
        _search(k), "query_row long, query_id long, vec_id long, row long, score long"
    )
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_row", "query_id", "rank", "vec_id", "score")
    )


def search_embeddings(
    vectors: DataFrame,
    asked,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Top ``k`` of the rows for which ``asked(vec_id)`` holds, among all other rows.

    Vectors that are null or hold a null or a non-finite component take no part, nor do rows
    without an id. Repeated ids are rows of their own: each asks, and each is found.
    """
    prepare_workers(vectors.sparkSession)
    whole = written(quantised(vectors, id_col, vector_col, scale), "vectors")
    return top_k(whole, whole.where(asked(F.col("vec_id"))), k)
