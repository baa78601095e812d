"""Cost-balanced packing of documents into sequences of fixed token capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import prepare_workers
from lethe.llm.token_files import list_array
from lethe.llm.tokens import encode_all, vocabulary_path

CAPACITY = 1024
# Tokens packed together: bounds a task's memory, and padding is under one sequence of these.
GROUP_TOKENS = 1 << 21
# A piece of n tokens costs LINEAR * n + QUADRATIC * n * n: the layers', and the attention's.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

SEQUENCE_BITS = 40  # sequences of one task; the task's number stands above them

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def place_pieces(
    sizes: np.ndarray, capacity: int = CAPACITY
) -> Iterator[tuple[int, int, int, int, int]]:
    """Yield ``(document, start, length, sequence, offset)`` for documents of these sizes.

    A document first gives its full sequences. The remainders are taken in descending order;
    each goes to the sequence of lowest cost that has room for it, out of as few sequences as
    can hold them all. If none has room, it fills the roomiest one and its rest is placed the
    same way. So the unused places of all sequences together are fewer than ``capacity``.
    """
    sequence = 0
    for doc in np.flatnonzero(sizes >= capacity):
        for start in range(0, int(sizes[doc]) - capacity + 1, capacity):
            yield int(doc), start, capacity, sequence, 0
            sequence += 1
    rests = sizes % capacity
    room = np.full(-(-int(rests.sum()) // capacity), capacity, "i8")
    cost = np.zeros(len(room))
    for doc in np.argsort(-rests, kind="stable"):
        left, start = int(rests[doc]), int(sizes[doc] - rests[doc])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            to = int(fits.argmin())
            length = left
            if np.isinf(fits[to]):
                to = int(room.argmax())
                length = int(room[to])
            yield int(doc), start, length, sequence + to, capacity - int(room[to])
            room[to] -= length
            cost[to] += LINEAR * length + QUADRATIC * length * length
            start, left = start + length, left - length


def _pack(
    path: str,
    end_id: int,
    capacity: int,
    group_tokens: int,
    with_ids: bool,
    special_tokens: bool,
):
    end = np.array([end_id], "<u4")
    names = [f.split()[0] for f in PIECES.split(", ")] + (["ids"] if with_ids else [])

    def packed(docs: list, ids: list[np.ndarray], base: int) -> tuple[pa.RecordBatch, int]:
        sizes = np.array([len(i) for i in ids], "i8")
        rows = list(place_pieces(sizes, capacity))
        doc, start, length, sequence, offset = (np.array(c, "i8") for c in zip(*rows, strict=True))
        parts = [ids[d][s : s + n] for d, s, n in zip(doc, start, length, strict=True)]
        columns = [
            pa.array([docs[d] for d in doc], pa.int64()),
            pa.array(start),
            pa.array(length),
            pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
            pa.array(sizes[doc]),
            pa.array(base + sequence),
            pa.array(offset),
        ]
        if with_ids:
            columns.append(list_array(parts))
        return pa.RecordBatch.from_arrays(columns, names=names), int(sequence.max()) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        docs, ids, held = [], [], 0
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            names_of = (d.as_py() for d in batch.column("doc_id"))
            for doc, encoded in zip(names_of, encode_all(texts, path, special_tokens), strict=True):
                docs.append(doc)
                ids.append(np.concatenate([encoded, end]))
                held += len(encoded) + 1
                if held >= group_tokens:
                    out, used = packed(docs, ids, base)
                    yield out
                    docs, ids, held, base = [], [], 0, base + used
        if docs:
            yield packed(docs, ids, base)[0]

    return pack


def pack_documents(
    df: DataFrame,
    end_id: int,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = False,
    special_tokens: bool = False,
) -> DataFrame:
    """One row per piece: the document's part, and its sequence and place there.

    Each task encodes its rows, a null text as empty, ends every document with ``end_id`` and
    packs groups of about ``group_tokens``. Nothing is shuffled, so a document, a source or a
    group of copies of any size only fills more sequences. Rows are told apart, not ids: a
    repeated or null id is packed like any other. A sequence lies in one task; its number holds
    the task's, and a task that runs again gives the same pieces. An empty table gives no
    pieces. Extra columns are not read. The string of a special token is ordinary text unless
    ``special_tokens`` is set.
    """
    prepare_workers(df.sparkSession)
    path = vocabulary or vocabulary_path()
    pack = _pack(path, end_id, capacity, group_tokens, with_ids, special_tokens)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pack, PIECES + (", ids array<int>" if with_ids else ""))
