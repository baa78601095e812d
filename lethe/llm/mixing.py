"""Mixing sources to target weights by exact cuts through hash-random orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import WHITE, free_name, row_number_in_task, with_row_key, written

# A source is repeated at most this often; what it cannot give goes to the others.
MOST_EPOCHS = 3
WORD = f"[^{WHITE}]+"


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float = 1.0) -> DataFrame:
    """One row per source: ``source, source_size, target``, in words.

    Sources by code point, null last, take the weights in turn, repeating them. Together they
    share ``share`` of all words by weight, but no target exceeds ``MOST_EPOCHS`` times its
    source; the excess goes to the rest by weight until none is above. That level is found in
    one pass: sources ordered by limit per weight fill up in this order. The table has one
    row per source, so its windows stay small however many rows a source has.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = (
        per_source.withColumn("turn", turn)
        .withColumn("weight", F.get(listed, F.col("turn") % len(weights)))
        .withColumn("most", F.col("source_size") * MOST_EPOCHS)
        .where("weight > 0")
    )
    order = Window.orderBy(F.col("most") / F.col("weight"), "turn")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # What is left for this source and those after it, if all before it are full.
    level = weighed.select(
        "*",
        (
            (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(ahead), F.lit(0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
        ).alias("level"),
    )
    full = F.col("most") < F.col("weight") * F.col("level")
    # The first source that is not full fixes the level of the rest.
    lasting = F.min(F.when(~full, F.struct(F.col("most") / F.col("weight"), "turn", "level"))).over(whole)
    return level.select(
        "source",
        "source_size",
        F.when(full, F.col("most").cast("double"))
        .otherwise(F.col("weight") * lasting["level"])
        .alias("target"),
    )


def running_sizes(sized: DataFrame, key: Column, carried: Sequence[str]) -> DataFrame:
    """Add ``before``: the words that stand before a row in its source's random order.

    Rows are range-partitioned by source, key and place, so a source, or a repeated key, that
    holds a third of all rows lies in many partitions. Each partition is summed per source,
    those few sums are accumulated, and a window adds up within a partition.
    """
    ordered = (
        sized.withColumn("mix_key", key)
        .repartitionByRange(F.col("source").asc_nulls_last(), "mix_key", "size", "place")
        .withColumn("part", F.spark_partition_id())
    )
    ranged = written(ordered.select(*carried, "source", "size", "mix_key", "place", "part"), "mixed")
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("o_source"),
        F.col("part").alias("o_part"),
        F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("offset"),
    )
    within = (
        Window.partitionBy("part", "source")
        .orderBy("mix_key", "size", "place")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(
            offsets,
            (F.col("part") == F.col("o_part")) & F.col("source").eqNullSafe(F.col("o_source")),
        )
        .select(*carried, "source", "size", (F.col("offset") + F.col("inside")).alias("before"))
    )


def mix_sources(
    df: DataFrame,
    weights: Sequence[float],
    share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_key: str | None = None,
    seed: str = "",
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, and the row key.

    A source gives its whole epochs first; the rest of its budget is read off its documents
    in the order of the MD5 of seed and id, and the document on the cut gives the words up to
    it. So the words taken are the target, rounded to whole words, and no document gives more
    than ``MOST_EPOCHS`` times its size. The order depends on id, size and source alone:
    reruns agree, and rows with the same id and size are alike. A null text has no words, a
    null source is a source of its own, a null id sorts first. Extra columns are not read.
    """
    carried = ["doc_id"] + (["row_key"] if row_key else [])
    sized = written(
        df.select(
            F.col(id_col).alias("doc_id"),
            *([F.col(row_key).alias("row_key")] if row_key else []),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            row_number_in_task().alias("place"),
        ),
        "sizes",
    )
    targets = source_targets(sized, weights, share).select(
        F.col("source").alias("t_source"), "source_size", "target"
    )
    key = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    placed = running_sizes(sized, key, carried).join(
        targets,
        F.col("source").eqNullSafe(F.col("t_source")),
        "left",
    )
    target = F.coalesce("target", F.lit(0.0))
    budget = F.round(target).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select(
        *carried,
        "size",
        F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        target.alias("target"),
        (epochs * F.col("size") + partial).cast("long").alias("taken"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    pieces = F.regexp_extract_all(text, F.lit(f"([{WHITE}]*{WORD})"), 1)
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(
    df: DataFrame,
    weights: Sequence[float],
    share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length_col: str | None = "n_chars",
    seed: str = "",
) -> DataFrame:
    """The mix itself: the rows of ``df`` as often as they are taken, all columns as they are.

    A document taken ``e`` times and ``w`` words more stands ``e`` times whole and once with
    its first ``w`` words; ``length_col``, if there, is the length of the text that stands.
    Rows that are not taken, those without words among them, go.
    """
    key = free_name("row_key", df.columns)
    keyed = with_row_key(df, key).withColumn(key, F.unhex(F.md5(key)))
    shares = mix_sources(keyed, weights, share, id_col, text_col, source_col, key, seed)
    epochs, words, turn = (
        free_name(n, keyed.columns) for n in ("mix_epochs", "mix_words", "mix_turn")
    )
    taken = shares.where("taken > 0").select(
        F.col("row_key").alias(key),
        F.floor(F.col("taken") / F.col("size")).cast("int").alias(epochs),
        (F.col("taken") % F.col("size")).alias(words),
    )
    turns = F.sequence(F.lit(1), F.col(epochs) + F.when(F.col(words) > 0, 1).otherwise(0))
    mixed = keyed.join(taken, key).withColumn(turn, F.explode(turns))
    text = F.when(F.col(turn) > F.col(epochs), first_words(F.col(text_col), F.col(words)))
    mixed = mixed.withColumn(text_col, F.coalesce(text, F.col(text_col)))
    if length_col in df.columns:
        kind = df.schema[length_col].dataType
        mixed = mixed.withColumn(length_col, F.char_length(text_col).cast(kind))
    return mixed.select(*df.columns)
