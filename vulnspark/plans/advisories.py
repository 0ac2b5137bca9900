"""From pages to records to features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from vulnspark.operators.cleaning import clean_records
from vulnspark.operators.features import build_features
from vulnspark.operators.pages import collect_per_term, extract_records
from vulnspark.operators.reshape import nest_records


def collect_records(
    pages: DataFrame, html: str = "html", attack: str = "attack", order: Sequence[str] = ("seq",),
    limit: int | None = None,
) -> DataFrame:
    """Stored pages to raw records: all pages, or the first ``limit`` per search term, parsed and tagged."""
    return extract_records(collect_per_term(pages, attack, order, limit), html, attack, order)


def features_from_raw(
    raw: DataFrame, order: Sequence[str] = ("_seq",), legacy: bool = False
) -> DataFrame:
    """Clean, reshape and derive in one lazy plan with a single exchange.

    ``order`` names columns of ``raw`` that start with an underscore; such columns
    travel along through every step.
    """
    return build_features(nest_records(clean_records(raw, legacy=legacy)), order)
