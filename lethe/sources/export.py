"""Ledger exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe import schemas


def receipts(ledger: DataFrame) -> DataFrame:
    """One receipt per certificate: its file name and JSON text."""
    fields = schemas.CERTIFICATE.fieldNames()
    return ledger.select(
        F.concat(F.lit("receipt_"), F.col("audit_id"), F.lit(".json")).alias("file_name"),
        F.to_json(F.struct(*fields)).alias("receipt"),
    )


def export_ledger_lines(ledger: DataFrame, path: str) -> None:
    """The ledger as JSON lines, written in parallel."""
    ledger.select(*schemas.CERTIFICATE.fieldNames()).write.json(path)


def export_ledger_array(ledger: DataFrame, path: str) -> None:
    """The ledger as one JSON array over several text parts, ordered by audit id.

    The parts, concatenated by name, are the array: brackets are lines of their own sorted
    before and after the certificates, and every certificate but the first opens with a comma.
    So no task ever holds the array, whatever its size.
    """
    fields = schemas.CERTIFICATE.fieldNames()
    first = ledger.agg(F.min("audit_id")).first()[0]
    comma = F.when(F.col("audit_id") == F.lit(first), F.lit("")).otherwise(F.lit(","))
    rows = ledger.select(
        F.lit(1).alias("part"),
        "audit_id",
        F.concat(comma, F.to_json(F.struct(*fields))).alias("value"),
    )
    brackets = ledger.sparkSession.createDataFrame(
        [(0, "", "["), (2, "", "]")], "part int, audit_id string, value string"
    )
    ordered = rows.unionByName(brackets).orderBy("part", "audit_id")
    ordered.select("value").write.text(path)
