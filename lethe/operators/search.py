"""Search of ledgers through an index of the letters that stand together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.operators.telemetry import SEARCHED, search_certificates

GRAM = 3  # letters; a shorter query is answered by a scan
BUCKETS = 256


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram), F.lit(BUCKETS)).cast("int")


def _grams(text: Column) -> Column:
    """Distinct runs of :data:`GRAM` letters of a text, ignoring case."""
    folded = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.length(folded) - (GRAM - 1), F.lit(1)))
    cut = F.transform(places, lambda i: F.substring(folded, i, F.lit(GRAM)))
    return F.array_distinct(F.filter(cut, lambda g: F.length(g) == GRAM))


def search_postings(ledger: DataFrame) -> DataFrame:
    """``gram, field, audit_id, bucket``: which certificates have which letters in which column."""
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("text"))
            for name in SEARCHED
        ]
    )
    rows = ledger.select("audit_id", F.explode(fields).alias("f"))
    grams = rows.select("audit_id", "f.field", F.explode(_grams(F.col("f.text"))).alias("gram"))
    return grams.distinct().withColumn("bucket", _bucket(F.col("gram")))


def write_search_index(ledger: DataFrame, path: str, mode: str = "append") -> None:
    """Add certificates, which all have an audit id, to the index at ``path``. A purge does not
    touch it, as certificates stay.

    Postings are laid out by a hash of the letters, and dealt out by letters and certificate, so
    common letters are many files.
    """
    postings = search_postings(ledger)
    (
        postings.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "gram")
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(path)
    )


def search_indexed(ledger: DataFrame, path: str, query: str) -> DataFrame:
    """As :func:`~lethe.operators.telemetry.search_certificates`, by the index at ``path``.

    Only the slices of the query's own letters are read. A certificate that has all of them in
    one column is a candidate, and candidates are looked at themselves.
    """
    if not query.strip():
        return search_certificates(ledger, query)
    spark = ledger.sparkSession
    wanted = spark.range(1).select(F.explode(_grams(F.lit(query.lower()))).alias("gram"))
    grams = wanted.select("gram", _bucket(F.col("gram")).alias("bucket")).collect()
    if not grams:
        return search_certificates(ledger, query)
    schema = "gram string, field string, audit_id string, bucket int"
    near = F.col("bucket").isin([r.bucket for r in grams])
    hits = (
        spark.read.schema(schema)
        .parquet(path)
        .where(near & F.col("gram").isin([r.gram for r in grams]))
        .select("audit_id", "field", "gram")
        .distinct()
        .groupBy("audit_id", "field")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(grams))
        .select("audit_id")
        .distinct()
    )
    return search_certificates(ledger.join(hits, "audit_id", "left_semi"), query)
