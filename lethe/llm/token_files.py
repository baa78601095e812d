"""Token ids of whole documents as Parquet list columns, written in id order and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe.llm.common import prepare_workers, row_number_in_task
from lethe.llm.tokens import encode_all, vocabulary_path
from lethe.session import new_dir

# Layout of a file. Ids repeat, so they get a dictionary: one page of at most 4 bytes per
# vocabulary entry, then indexes of 16 bits. The ascending number columns are delta encoded,
# which format version 2 does wherever there is no dictionary. Small pages and the page index
# that the writer adds to each row group let a reader skip to a range of documents.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}

SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
ROWS_OUT = 512  # documents per batch handed back to Spark


def list_array(parts: list[np.ndarray], end: np.ndarray | None = None) -> pa.ListArray:
    """Lists over one flat buffer of ids, each followed by ``end`` if given."""
    offsets = np.zeros(len(parts) + 1, "i4")
    np.cumsum([len(p) + (end is not None) for p in parts], out=offsets[1:])
    if end is not None:
        parts = [ids for part in parts for ids in (part, end)]
    flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view("<i4")))


def _encode(path: str, end_id: int, special_tokens: bool):
    end = np.array([end_id], "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                rows = batch.slice(at, ROWS_OUT)
                texts = rows.column("text").to_pylist()
                ids = list(encode_all(texts, path, special_tokens))
                sizes = np.array([len(i) + 1 for i in ids], "i8")
                firsts = total + np.cumsum(sizes) - sizes
                total += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(np.full(len(ids), part, "i4")),
                        pa.array(firsts),
                        pa.array(sizes),
                        list_array(ids, end),
                    ],
                    names=["doc_id", "part", "first", "n_tokens", "ids"],
                )

    return encode


def write_token_files(
    df: DataFrame,
    path: str,
    end_id: int,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    special_tokens: bool = False,
) -> None:
    """Write ``doc_id, part, first, n_tokens, ids``, one row per document, in id order.

    A null text is empty, so its ids are the end id alone. Rows are range-partitioned by id and
    place; a repeated id may fill several files, its rows follow one another. A null id comes
    first. ``part`` numbers the files in order and ``first`` counts the ids before the document
    in its file. Only ids and texts are read. An empty table gives files without rows.
    The string of a special token is ordinary text unless ``special_tokens`` is set.
    """
    prepare_workers(df.sparkSession)
    encode = _encode(vocabulary or vocabulary_path(), end_id, special_tokens)
    ordered = (
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(text_col).alias("text"),
            row_number_in_task().alias("place"),
        )
        .repartitionByRange("doc_id", "place")
        .sortWithinPartitions("doc_id", "place")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`write_token_files`; unused columns are not read from the files."""
    return spark.read.schema(SCHEMA).parquet(path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, part, first``: where each document begins, without its ids.

    The few sums per file are accumulated; a document's place in its file is stored.
    """
    rows = read_token_files(spark, path).select("doc_id", "part", "first", "n_tokens")
    return rows.join(_file_starts(rows), "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "part", "first"
    )


def _file_starts(rows: DataFrame) -> DataFrame:
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))


def ids_digest(lists: pa.ListArray) -> np.ndarray:
    """Unsigned CRC-32 of each list, as little-endian unsigned 32-bit integers."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy().astype("<u4", copy=False)
    return np.array(
        [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)], "i8"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("part"),
                batch.column("first"),
                pa.array(np.diff(lists.offsets.to_numpy()).astype("i8")),
                pa.array(ids_digest(lists)),
            ],
            names=["doc_id", "part", "first", "n_tokens", "ids_crc32"],
        )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the ids as they lie in the files."""
    rows = read_token_files(spark, path)
    read = rows.select("doc_id", "part", "first", "ids").mapInArrow(
        _digest, "doc_id long, part int, first long, n_tokens long, ids_crc32 long"
    )
    starts = _file_starts(rows.select("part", "n_tokens"))
    return read.join(starts, "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def new_token_dir(spark: SparkSession) -> str:
    return new_dir(spark, "llm-tokens")
