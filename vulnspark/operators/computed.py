"""Filtering on derived columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` for conditions on columns that are costly to derive.

    A filter is moved below the projection that derives its columns, which then
    computes them twice: parsing, regular expressions and list rules would run once
    for the filter and once for the result. A row number in between keeps the filter
    where it is written. Conditions on stored columns belong in a plain ``where``,
    which the scan can use.
    """
    numbered = df.select("*", F.monotonically_increasing_id().alias("_held"))
    return numbered.where(condition & (F.col("_held") >= 0)).drop("_held")
