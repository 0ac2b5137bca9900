"""One row per key, and at most n rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row per key.

    ``order`` must order the rows of a key completely. Each task keeps one row
    per key before the exchange (a partial group limit), so a key that holds a
    third of all rows sends one row per task.
    """
    last_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(last_first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def cap_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int, fan_in: int = 64
) -> DataFrame:
    """Keep the first ``n`` rows per group.

    Few groups with many rows are the normal case (search terms). The rows are
    ranked in two steps: within ``fan_in`` slices of each group, then over what
    is left, so that no task sees the candidates of every upstream task.
    The slice of a row does not matter for the result.
    """
    sliced = df.withColumn("_slice", F.spark_partition_id() % fan_in)
    ordering = [F.col(c).asc() for c in order]
    for keys in ([*groups, "_slice"], [*groups]):
        first = Window.partitionBy(*keys).orderBy(*ordering)
        sliced = (
            sliced.withColumn("_rank", F.row_number().over(first))
            .where(F.col("_rank") <= n)
            .drop("_rank")
        )
    return sliced.drop("_slice")


def first_n(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in order; 0 or None means all of them."""
    if not n:
        return df
    return df.orderBy(*order).limit(n)
