"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import WHITE, place_of, row_number_in_task, task_of, with_row_key, written

# Rows of one run at the leaves, and runs merged into one per round.
RUN_ROWS = 1 << 16
FAN_IN = 8

# Two texts count as equal if all three agree: the digest, and as its verification the length
# in bytes and an unrelated 64-bit hash.
IDENTITY = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]+", " ")


def digests(df: DataFrame, id_col: str, text_col: str, row_key: str | None = None) -> DataFrame:
    """Id, row key and identity of each row, written with the place of the row: the leaves."""
    carried = [F.col(row_key).alias("row_key")] if row_key else []
    text = df.select(
        F.col(id_col).alias("doc_id"), *carried, normalised(F.col(text_col)).alias("norm")
    )
    return written(
        text.select(
            "doc_id",
            *[c for c in ("row_key",) if row_key],
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("check"),
            row_number_in_task().alias("row"),
        ),
        "digests",
    )


def merge_runs(leaves: DataFrame, fan_in: int = FAN_IN, run_rows: int = RUN_ROWS) -> DataFrame:
    """Add to every leaf row the smallest id of its text, that row, and the group's size.

    Leaf rows form runs of at most ``run_rows``. A run keeps per identity its smallest
    ``(id is null, id, row)`` and its count. Rounds then merge ``fan_in`` neighbouring runs
    into one, sorted by identity, until one run is left; a run is spread over tasks by
    identity, so none is ever held whole. The winners travel down again from run to run: the
    root to the leaf runs, the leaf runs to their rows. At every step a task meets at most
    ``fan_in`` entries, or one leaf run's rows, of a text, so a text that fills a third of
    the table makes no large group.
    """
    blocks = F.floor(place_of(F.col("row")) / run_rows)
    sizes = leaves.agg(
        F.max(task_of(F.col("row"))).alias("task"), F.max(blocks).alias("block")
    ).head()
    width = (sizes["block"] or 0) + 1
    runs = (sizes["task"] or 0) * width + width
    rows = leaves.withColumn("run", task_of(F.col("row")) * width + blocks)

    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    level = rows.groupBy("run", *IDENTITY).agg(
        F.min(first).alias("first"), F.count("*").alias("n")
    )
    leaf_level = level = written(level, "runs")
    while runs > 1:
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in))
            .groupBy("run", *IDENTITY)
            .agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        )
        runs = -(-runs // fan_in)
    root = level.select(*IDENTITY, F.col("first").alias("winner"), F.col("n").alias("total"))
    # Most texts occur once: only groups that met another run or row are sent down.
    repeated = root.where("total > 1")
    down = leaf_level.select("run", *IDENTITY).join(repeated, IDENTITY)
    own = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    return rows.join(down, ["run", *IDENTITY], "left").select(
        *leaves.columns,
        F.coalesce("winner", own).alias("winner"),
        F.coalesce("total", F.lit(1)).alias("group_size"),
    )


def find_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_key: str | None = None
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after :func:`normalised`; null counts as empty. The row with
    the smallest id stays. Rows without an id stay only if no row of the group has one; of
    rows that repeat the smallest id, one stays. Extra columns are not read. An empty table
    gives an empty result. With ``row_key`` that column is returned as ``row_key`` too.
    """
    merged = merge_runs(digests(df, id_col, text_col, row_key))
    return merged.select(
        "doc_id",
        *[c for c in ("row_key",) if row_key],
        F.col("winner.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns as they are."""
    from lethe.llm.common import free_name

    key = free_name("row_key", df.columns)
    keyed = with_row_key(df, key)
    gone = find_copies(keyed, id_col, text_col, key).where(~F.col("kept"))
    return keyed.join(
        gone.select(F.col("row_key").alias(key)), key, "left_anti"
    ).drop(key)
