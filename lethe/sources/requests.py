"""Request readers: payloads in the wire form (JSON text), or request tables.

A payload is a line of text, or with the document readers a whole file: an object or an array
of objects for ingest, an object with an ``entity_id`` or a bare array of ids for unlearn. Every
payload is a batch. Batch ids and sequence numbers follow from the file's path and the position
in it, not from how Spark splits the files, so a repeated read gives the same batch ids, and
sequence numbers in the same order. Nothing is dropped: a payload that is not valid, and one
that is empty, are listed among the batches for the jobs to answer.

Payload texts are never copied: numbers come from counts per file piece, and the texts are read
where they lie. What jobs store of them is theirs to erase.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe import schemas
from lethe.operators.ranks import with_running_sum
from lethe.operators.triplets import unnest
from lethe.session import materialise

BLANK = " \t\r\n"


@dataclass(frozen=True)
class Payloads:
    """Requests with ``batch_id``, ``seq`` and the ``item`` of their batch, every batch with
    whether it was readable, and the first sequence number that is still free."""

    requests: DataFrame
    batches: DataFrame  # batch_id, malformed
    end: int


def parse_ingest_payload(payload: Column) -> Column:
    """Array of ``{id, entity_id, text}`` from a JSON object or a JSON array of objects.

    Null for text that is neither, the case a caller reports as a malformed payload.
    """
    return F.from_json(payload, f"array<{schemas.INGEST_PAYLOAD.simpleString()}>")


def parse_unlearn_payload(payload: Column) -> Column:
    """Array of entity ids from ``{"entity_id": …}`` or from a bare JSON array of ids."""
    single = F.from_json(payload, schemas.UNLEARN_PAYLOAD)["entity_id"]
    start = F.ltrim(payload, F.lit(BLANK))
    named = F.get_json_object(payload, "$").isNotNull() & F.startswith(start, F.lit("{"))
    return F.when(
        F.startswith(start, F.lit("[")), F.from_json(payload, "array<string>")
    ).otherwise(F.when(named, F.array(single)))


def _explode(requests: DataFrame, payload: str, items: Column) -> DataFrame:
    keep = [c for c in requests.columns if c != payload]
    return unnest(requests, items, "item", "_item", *keep)  # parses each payload once


def explode_ingest(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per request of the readable payloads; ``item`` is its position in the payload."""
    rows = _explode(requests, payload, parse_ingest_payload(F.col(payload)))
    return rows.select(
        *rows.columns[:-1], "_item.id", "_item.entity_id", "_item.text"
    )


def explode_unlearn(requests: DataFrame, payload: str = "payload") -> DataFrame:
    return _explode(requests, payload, parse_unlearn_payload(F.col(payload))).withColumnRenamed(
        "_item", "entity_id"
    )


def payload_texts(reader_or_spark, path: str, whole_files: bool = False) -> DataFrame:
    """``payload, file, block``: lines of text files, or whole files, batch or stream, that are
    not blank."""
    return (
        reader_or_spark.text(path, wholetext=whole_files)
        .select(
            F.col("value").alias("payload"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .where(F.length(F.btrim("payload", F.lit(BLANK))) > 0)
    )


PIECE = ["file", "block"]


def number_payloads(texts: DataFrame, n_items: Column) -> tuple[DataFrame, int, int]:
    """Adds ``batch_id`` and ``number``, from 0 in the order of file and position; also the
    number of payloads, and the most items that one of them has.

    A piece of a file is read by one task from its beginning, so a payload's place in it is the
    distance to the piece's first row number. What is written and accumulated is one row of
    counts per piece: no text is copied or shuffled. The counts are written last of all, as the
    optimizer broadcasts what it knows to be small, and knows it of files only.
    """
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    pieces = rows.groupBy(*PIECE).agg(
        F.min("row").alias("first_row"),
        F.count(F.lit(1)).alias("n"),
        F.max(n_items).alias("most"),
    )
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("in_file", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    starts = materialise(with_running_sum(placed, PIECE, value="n"), "pieces")
    found = starts.agg(F.sum("n"), F.max("most")).first()
    place = F.col("row") - F.col("first_row")
    numbered = rows.join(starts, PIECE).select(
        *texts.columns,
        F.concat_ws(":", "file", (F.col("in_file") + place).cast("string")).alias("batch_id"),
        (F.col("before") + place).alias("number"),
    )
    return numbered, found[0] or 0, max(found[1] or 0, 1)


def _payloads(texts: DataFrame, first_seq: int, parse, explode) -> Payloads:
    """Each payload has as many sequence numbers as the largest one has items, so there is no
    limit to the length of a payload, and splits do not matter."""
    n_items = F.greatest(F.coalesce(F.size(parse(F.col("payload"))), F.lit(0)), F.lit(0))
    numbered, count, most = number_payloads(texts, n_items.cast("long"))
    rows = explode(numbered.select("batch_id", "number", "payload"))
    fields = [c for c in rows.columns if c not in ("batch_id", "number", "item")]
    seq = F.lit(first_seq).cast("long") + F.col("number") * most + F.col("item")
    return Payloads(
        rows.select("batch_id", seq.alias("seq"), "item", *fields),
        numbered.select("batch_id", parse(F.col("payload")).isNull().alias("malformed")),
        first_seq + count * most,
    )


def ingest_payloads(texts: DataFrame, first_seq: int = 0) -> Payloads:
    return _payloads(texts, first_seq, parse_ingest_payload, explode_ingest)


def unlearn_payloads(texts: DataFrame, first_seq: int = 0) -> Payloads:
    return _payloads(texts, first_seq, parse_unlearn_payload, explode_unlearn)


def read_ingest_payloads(spark: SparkSession, path: str, first_seq: int = 0) -> Payloads:
    """Ingest payloads of text files, one to a line; pass both parts to the ingest job."""
    return ingest_payloads(payload_texts(spark.read, path), first_seq)


def read_unlearn_payloads(spark: SparkSession, path: str, first_seq: int = 0) -> Payloads:
    return unlearn_payloads(payload_texts(spark.read, path), first_seq)


def read_ingest_documents(spark: SparkSession, path: str, first_seq: int = 0) -> Payloads:
    """As :func:`read_ingest_payloads` for files that hold one payload each, over any number of
    lines. A file is parsed by one task."""
    return ingest_payloads(payload_texts(spark.read, path, whole_files=True), first_seq)


def read_unlearn_documents(spark: SparkSession, path: str, first_seq: int = 0) -> Payloads:
    return unlearn_payloads(payload_texts(spark.read, path, whole_files=True), first_seq)


def stream_payloads(
    spark: SparkSession,
    path: str,
    files_per_trigger: int | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """Payloads as a stream, objects and arrays, a line or a file each, for the streaming jobs
    to number."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return payload_texts(reader, path, whole_files)


def read_ingest_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Request tables that carry ``batch_id`` and ``seq``: JSON lines, parquet or other."""
    return spark.read.schema(schemas.INGEST_REQUEST).format(fmt).load(path)


def read_unlearn_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.UNLEARN_REQUEST).format(fmt).load(path)


def stream_ingest_requests(
    spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None
) -> DataFrame:
    return _stream(spark, schemas.INGEST_REQUEST, path, fmt, files_per_trigger)


def stream_unlearn_requests(
    spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None
) -> DataFrame:
    return _stream(spark, schemas.UNLEARN_REQUEST, path, fmt, files_per_trigger)


def _stream(spark, schema, path, fmt, files_per_trigger) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
