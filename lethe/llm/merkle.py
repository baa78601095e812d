"""Merkle manifests of whole tables: trees of hashes rolled up inside bounded blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import row_number_in_task, written
from lethe.operators.ranks import with_running_sum

FAN_OUT = 8
DIGITS = 3  # of a place in a block, so a block holds FAN_OUT ** DIGITS nodes at most


def sha256_of(*parts: Column) -> Column:
    """Lowercase hex digest of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def field_code(value: Column) -> Column:
    """A value that can be told from every other: ``-`` for null, else its size in bytes, a
    colon and the value."""
    text = value.cast("string")
    coded = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("-")).otherwise(coded)


def row_digest(*values: Column) -> Column:
    return sha256_of(*[field_code(v) for v in values])


def _block_digits() -> list[Column]:
    """Digits of the place in its block, lowest first."""
    return [
        (F.floor(F.col("place") / FAN_OUT**i) % FAN_OUT).cast("int").alias(f"d{i}")
        for i in range(DIGITS)
    ]


def _is_node(level: int) -> Column:
    """Whether nodes of this level are hashes: a group with a single node left is done."""
    return F.col("n") > FAN_OUT ** (level - 1)


def roll_up(nodes: DataFrame) -> DataFrame:
    """``grp, n, block, hash, kids`` from ``grp, n, place, hash, item``.

    The rows of a block meet in one shuffle. The digits of the place are then grouped away one
    after the other, from the lowest, each time nesting the structs of the children; all
    groupings keep the partitioning by block. ``n`` is the number of nodes of the group.
    """
    rows = nodes.select(
        "grp",
        "n",
        F.floor(F.col("place") / FAN_OUT**DIGITS).cast("long").alias("block"),
        *_block_digits(),
        "hash",
        F.col("item").alias("below"),
    ).repartition("grp", "n", "block")
    for level in range(1, DIGITS + 1):
        child = F.struct(F.col(f"d{level - 1}").alias("digit"), "hash", "below")
        left = [f"d{i}" for i in range(level, DIGITS)]
        kids = rows.groupBy("grp", "n", "block", *left).agg(
            F.sort_array(F.collect_list(child)).alias("below")
        )
        joined = F.sha2(F.array_join("below.hash", ""), 256)
        rows = kids.select(
            "grp",
            "n",
            "block",
            *left,
            F.when(_is_node(level), joined).otherwise(F.col("below")[0]["hash"]).alias("hash"),
            "below",
        )
    return rows.select("grp", "n", "block", "hash", F.col("below").alias("kids"))


def spread_paths(blocks: DataFrame) -> DataFrame:
    """One row per node of blocks that know their own ``path``: the block's carried columns,
    the node's ``item`` and its path, from the node up.

    A step of a path holds the hashes left and right of the node in its run, put together.
    """

    def walk(kids: Column, level: int, above: Column) -> Column:
        def of_child(kid: Column, i: Column) -> Column:
            left = F.array_join(F.slice(kids["hash"], F.lit(1), i), "")
            right = F.array_join(F.slice(kids["hash"], i + 2, F.lit(FAN_OUT)), "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            path = F.when(_is_node(level), F.concat(step, above)).otherwise(above)
            if level == 1:
                return F.struct(kid["below"].alias("item"), path.alias("path"))
            return walk(kid["below"], level - 1, path)

        found = F.transform(kids, of_child)
        return found if level == 1 else F.flatten(found)

    rows = F.inline(walk(F.col("kids"), DIGITS, F.col("path")))
    return blocks.select("grp", "subroot", "root", rows)


def _rolled(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Blocks of leaves, blocks of their hashes, and so on until every group is one block."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds = []
    while True:
        blocks = written(roll_up(nodes), f"{label}-{len(rounds)}")
        rounds.append(blocks)
        if most <= FAN_OUT**DIGITS:
            return rounds
        most = -(-most // FAN_OUT**DIGITS)
        nodes = blocks.select(
            "grp",
            F.ceil(F.col("n") / FAN_OUT**DIGITS).cast("long").alias("n"),
            F.col("block").alias("place"),
            "hash",
            F.struct("block").alias("item"),
        )


EMPTY_PATH = "array<struct<left:string,right:string>>"


def _meet(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the path of their own hash: both lie in one row per block after grouping."""
    known = ["path", "subroot", "root"]
    both = blocks.select("grp", "block", "n", "kids").unionByName(
        paths.select("grp", "block", *known), allowMissingColumns=True
    )
    return both.groupBy("grp", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", *known)]
    )


def _go_down(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Nodes of the first round with their paths, from the paths of the last round's blocks."""
    for blocks in reversed(rounds[1:]):
        nodes = spread_paths(_meet(blocks, paths))
        paths = nodes.select(
            "grp", F.col("item")["block"].alias("block"), "path", "subroot", "root"
        )
    return spread_paths(_meet(rounds[0], paths))


def build_manifest(
    df: DataFrame,
    leaf: Column,
    group_col: str = "lang",
    order_col: str = "doc_id",
    carried: Sequence[Column] = (),
) -> DataFrame:
    """One row per row of ``df``: ``grp, leaf, subroot, root, path`` and the carried columns.

    The leaves of a group stand in ascending order of ``order_col``. While several nodes remain,
    every ``FAN_OUT`` consecutive ones are hashed into one, the last run with fewer, even a
    single one. The node left is the group's ``subroot``; the subroots in the order of their
    groups give ``root`` in the same way. ``path`` leads from the leaf to the root: per hash the
    digests on the left and on the right, put together; ``folded`` goes along it.

    Blocks of ``FAN_OUT ** DIGITS`` nodes are rolled up in tasks of their own, so a group of any
    size is spread, and a table of blocks is rolled up in turn. A null group is a group and comes
    first, null ids come first. Rows with the same id stand in the order of their leaves; equal
    rows are alike. An empty table gives no rows. Null and empty values differ. Extra columns
    are not read and may have any name.
    """
    leaves = written(
        df.select(
            F.col(group_col).alias("grp"),
            F.col(order_col).alias("ord"),
            leaf.alias("hash"),
            F.struct(leaf.alias("leaf"), *carried).alias("item"),
        ).withColumn("tie", row_number_in_task()),
        "leaves",
    )
    numbered = with_running_sum(
        leaves, ["ord", "hash", "tie"], ["grp"], before="place", total="n", write=written
    )
    rounds = _rolled(numbered.select("grp", "n", "place", "hash", "item"), "blocks")
    subroots = rounds[-1].select(F.lit(0).alias("all"), "grp", "hash")
    listed = with_running_sum(subroots, ["grp"], ["all"], before="place", total="n", write=written)
    above = _rolled(
        listed.select(F.col("all").alias("grp"), "n", "place", "hash", F.struct("grp", "hash").alias("item")),
        "subroots",
    )
    top = above[-1].select(
        "grp",
        "block",
        F.array().cast(EMPTY_PATH).alias("path"),
        F.lit(None).cast("string").alias("subroot"),
        F.col("hash").alias("root"),
    )
    paths = _go_down(above, top).select(
        F.col("item")["grp"].alias("grp"),
        F.lit(0).cast("long").alias("block"),
        "path",
        F.col("item")["hash"].alias("subroot"),
        "root",
    )
    return _go_down(rounds, paths).select("grp", "item.*", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings along a path."""
    steps = F.transform(path, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(steps, ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda h, s: sha256_of(s["left"], h, s["right"]))
