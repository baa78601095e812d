"""Request validation: per row, and per batch where one bad row rejects the whole batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe import messages
from lethe.functions.text import has_content, non_blank, valid_identifier


def ingest_error(request_id: Column, entity_id: Column, text: Column) -> Column:
    """Message of the first rule an ingest request breaks, or null."""
    return F.when(
        ~non_blank(text) | ~non_blank(entity_id), F.lit(messages.INGEST_BLANK)
    ).when(
        ~valid_identifier(request_id) | ~valid_identifier(entity_id),
        F.lit(messages.INGEST_INVALID),
    )


def unlearn_error(entity_id: Column) -> Column:
    return F.when(~valid_identifier(entity_id), F.lit(messages.UNLEARN_INVALID))


def unlearn_item_error(entity_id: Column) -> Column:
    """As :func:`unlearn_error` inside a batch, where the message quotes the id."""
    quoted = F.format_string(
        messages.UNLEARN_INVALID_ITEM, F.coalesce(entity_id, F.lit(""))
    )
    return F.when(~valid_identifier(entity_id), quoted)


def _status(error: Column) -> Column:
    return F.when(error.isNotNull(), F.lit(400)).otherwise(F.lit(200))


def classify_ingest(requests: DataFrame) -> DataFrame:
    """Adds ``status_code`` (200 or 400) and ``message`` (null when accepted)."""
    error = ingest_error(F.col("id"), F.col("entity_id"), F.col("text"))
    return requests.withColumn("message", error).withColumn(
        "status_code", _status(F.col("message"))
    )


def classify_unlearn(requests: DataFrame) -> DataFrame:
    """Adds ``status_code``, ``error`` and ``message``."""
    checked = requests.withColumn("message", unlearn_error(F.col("entity_id")))
    return checked.withColumn("status_code", _status(F.col("message"))).withColumn(
        "error", F.when(F.col("message").isNotNull(), F.lit(messages.INVALID_INPUT))
    )


def batch_verdicts(requests: DataFrame, error: Column) -> DataFrame:
    """One row per batch: ``size`` and the message of its first bad row by ``seq``, or null.

    Partial aggregation leaves one small row per batch and task, so a batch holding most of
    the rows costs no more than any other, and request texts are not shuffled.
    """
    return (
        requests.select("batch_id", "seq", error.alias("message"))
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min(
                F.when(F.col("message").isNotNull(), F.struct("seq", "message"))
            ).alias("first_bad"),
        )
        .select(
            "batch_id",
            "size",
            _status(F.col("first_bad")).alias("status_code"),
            F.col("first_bad.message").alias("message"),
        )
    )


def accepted(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of the batches without a bad row.

    The anti join keeps requests on its streamed side, the one adaptive execution may split
    when one batch dominates.
    """
    rejected = verdicts.where(F.col("message").isNotNull()).select("batch_id")
    return requests.join(rejected, "batch_id", "left_anti")


def ingest_checks(requests: DataFrame) -> DataFrame:
    """``batch_id, seq``, the ``message`` of a bad row and the ``task`` that read it: all that
    the check of batches needs, so that texts are read once for it."""
    error = ingest_error(F.col("id"), F.col("entity_id"), F.col("text"))
    task = F.spark_partition_id().alias("task")
    return requests.select("batch_id", "seq", error.alias("message"), task)


def ingest_batch_verdicts(requests: DataFrame) -> DataFrame:
    return batch_verdicts(ingest_checks(requests), F.col("message"))


def unlearn_batch_verdicts(requests: DataFrame) -> DataFrame:
    return batch_verdicts(requests, unlearn_item_error(F.col("entity_id")))


def embed_batch_verdicts(items: DataFrame) -> DataFrame:
    """Encoder input check: any blank text fails its whole batch."""
    error = F.when(~has_content(F.col("text")), F.lit(messages.EMBED_BLANK_BATCH))
    return batch_verdicts(items, error)


def with_empty_batches(verdicts: DataFrame, batches: DataFrame, message: str) -> DataFrame:
    """Adds the batches of ``batches`` that sent no row at all, rejected with ``message``, or
    as malformed where the column of that name says so."""
    malformed = F.col("malformed") if "malformed" in batches.columns else F.lit(False)
    empty = (
        batches.select("batch_id", malformed.alias("malformed"))
        .join(verdicts.select("batch_id"), "batch_id", "left_anti")
        .select(
            "batch_id",
            F.lit(0).cast("bigint").alias("size"),
            F.lit(400).alias("status_code"),
            F.when(F.col("malformed"), F.lit(messages.PAYLOAD_MALFORMED))
            .otherwise(F.lit(message))
            .alias("message"),
        )
    )
    return verdicts.unionByName(empty)


class UnnumberedRequests(ValueError):
    """Rows without a batch or a sequence number, which no rule of a batch could reach."""


def require_numbers(requests: DataFrame, task: Column | None = None) -> tuple[int, int]:
    """Refuse requests with a null ``batch_id`` or ``seq``; readers of payloads assign both.
    Gives the number of requests, and the most that one task read of them; ``task`` is which, if
    it is not the one that reads them now."""
    missing = F.col("batch_id").isNull() | F.col("seq").isNull()
    task = F.spark_partition_id() if task is None else task
    marked = requests.select(missing.alias("missing"), task.alias("task"))
    tasks = marked.groupBy("task").agg(
        F.count_if("missing").alias("missing"), F.count(F.lit(1)).alias("n")
    )
    count, total, most = tasks.agg(F.sum("missing"), F.sum("n"), F.max("n")).head()
    if count:
        raise UnnumberedRequests(f"{count} requests have no batch_id or no seq")
    return total or 0, most or 0


def embed_check(items: DataFrame) -> DataFrame:
    """Single-item encoder input check."""
    error = F.when(~has_content(F.col("text")), F.lit(messages.EMBED_BLANK))
    return items.withColumn("message", error)


def dimension_error(vector: Column, expected: int) -> Column:
    actual = F.coalesce(F.size(vector), F.lit(0))
    actual = F.when(actual < 0, F.lit(0)).otherwise(actual)
    return F.when(
        actual != expected,
        F.format_string(messages.DIMENSION_MISMATCH, F.lit(expected), actual),
    )


def vector_dim_check(vectors: DataFrame, expected: int) -> DataFrame:
    """Rows whose vector has the wrong length, with the error message."""
    checked = vectors.withColumn("message", dimension_error(F.col("vector"), expected))
    return checked.where(F.col("message").isNotNull()).select(
        "id",
        "entity_id",
        F.lit(expected).alias("expected"),
        F.size("vector").alias("actual"),
        "message",
    )
