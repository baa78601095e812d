"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_norm(vector: Column) -> Column:
    return F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )


def l2_norm(vector: Column) -> Column:
    return F.sqrt(squared_norm(vector))


def l2_normalise(vector: Column) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    scale = F.array(l2_norm(vector))  # evaluated once per row, not once per element
    return F.flatten(
        F.transform(
            scale,
            lambda n: F.transform(
                vector, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float")
            ),
        )
    )
