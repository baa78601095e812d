"""Places of rows in a total order, found without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.session import materialise

TASK_BITS = 33  # monotonically_increasing_id: the task above, the row in the task below


def _ordered(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _per_group(sums: DataFrame, within: Sequence[str], part: str) -> DataFrame:
    """Sums ahead of each range and over all ranges of its group."""
    group = Window.partitionBy(*within)
    ahead = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)],
        F.col(part).alias("_p"),
        "_start",
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"),
        F.sum("_sum").over(group).alias("_total"),
    )


def _overall(sums: DataFrame, part: str) -> DataFrame:
    """The same for a single group: a row per shuffle partition, added up on the driver."""
    rows = sorted((r[part], r["_start"], r["_sum"] or 0) for r in sums.collect())
    total, ahead = sum(r[2] for r in rows), 0
    offsets = []
    for at, start, own in rows:
        offsets.append((at, start, ahead, total))
        ahead += own
    schema = "_p int, _start long, _ahead long, _total long"
    return F.broadcast(sums.sparkSession.createDataFrame(offsets, schema))


def with_running_sum(
    df: DataFrame,
    order: Sequence[str | Column],
    within: Sequence[str] = (),
    value: str | None = None,
    before: str = "before",
    total: str | None = None,
    write: Callable[[DataFrame, str], DataFrame] = materialise,
) -> DataFrame:
    """Add ``before``, the sum of ``value`` over the rows that stand before a row in its group,
    and if named ``total``, the sum over the group. Without ``value`` rows are counted, so
    ``before`` is the place from 0.

    Rows are dealt by ranges of group and order, sorted there and written once; what remains
    to be accumulated is one row per range and group. A group of any size lies in many ranges.
    The order must tell rows apart where a rerun shall agree. ``write`` takes the intermediate
    table and a label and returns it read back.
    """
    keys = [*_ordered(within), *_ordered(order)]
    row, part, first = "_row", "_part", "_first"
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(row, F.monotonically_increasing_id())
        .withColumn(part, F.shiftrightunsigned(row, TASK_BITS).cast("int"))
    )
    if value is not None:
        inside = Window.partitionBy(part, *within).orderBy(row)
        placed = placed.withColumn(
            first, F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        )
    stored = write(placed, "ordered")
    sums = stored.groupBy(*within, part).agg(
        F.min(row).alias("_start"),
        (F.count(F.lit(1)) if value is None else F.sum(value)).alias("_sum"),
    )
    offsets = _per_group(sums, within, part) if within else _overall(sums, part)
    same = F.col(part) == F.col("_p")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = F.col(row) - F.col("_start") if value is None else F.coalesce(first, F.lit(0))
    added = [(F.col("_ahead") + inside).alias(before)]
    if total is not None:
        added.append(F.col("_total").alias(total))
    return stored.join(offsets, same).select(*df.columns, *added)
