"""Dashboard filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Severities shown unless the user picks others.
DEFAULT_SEVERITIES = ("Critical", "High", "Medium", "Low")


def any_of(
    df: DataFrame, column: str, wanted: Sequence[str], case_insensitive: bool = False
) -> DataFrame:
    """Rows whose value is in the list; an empty list keeps every row."""
    if not wanted:
        return df
    if case_insensitive:
        return df.where(F.lower(column).isin([w.lower() for w in wanted]))
    return df.where(F.col(column).isin(list(wanted)))


def min_score(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Rows with at least this score; a missing score counts as 0."""
    return df.where(F.coalesce(F.col(column), F.lit(0.0)) >= F.lit(float(minimum)))


def dashboard_filter(
    df: DataFrame,
    severities: Sequence[str] = DEFAULT_SEVERITIES,
    attack_types: Sequence[str] = (),
    minimum: float = 0.0,
    case_insensitive: bool = False,
) -> DataFrame:
    df = any_of(df, "severity", severities)
    df = any_of(df, "attack_type", attack_types, case_insensitive)
    return min_score(df, "cvss_score", minimum)
