"""What is read off the tables: dashboard, exploratory report, explanations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.nested import SEVERITIES
from vulnspark.functions.text import any_date
from vulnspark.operators import enrich, filters, search, stats
from vulnspark.operators.dedup import first_n
from vulnspark.operators.views import dashboard_view, explanation_input

# Display order of severities; attacks shown in the cross-tab.
SEVERITY_DISPLAY = ("Critical", "High", "Medium", "Low", "Unknown")
TARGET_ATTACKS = ("buffer overflow", "sql injection", "prompt injection", "cross-site scripting")


def panels(
    shown: DataFrame,
    severities: Sequence[str] = filters.DEFAULT_SEVERITIES,
    attack_types: Sequence[str] = (),
    minimum: float = 0.0,
    query: str = "",
    top_k: int | None = 25,
    stop_words: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """All panels over the filtered rows of a dashboard view.

    Persist the view, or keep it as Parquet, before asking for several panels.
    """
    rows = filters.dashboard_filter(shown, severities, attack_types, minimum)
    return {
        "rows": rows,
        "key_figures": stats.key_figures(rows, "severity", "cvss_score"),
        "severities": stats.ordered_counts(rows, "severity", SEVERITY_DISPLAY),
        "attack_types": stats.shares(rows, "attack_type"),
        "score_histogram": stats.fitted_histogram(rows, "cvss_score"),
        "score_bands": stats.at_least(rows, "cvss_score", (9.0, 7.0)),
        "top_cwe": stats.top_present(rows, "cwe"),
        "top_vendors": stats.exploded_counts(rows, "vendor").limit(10),
        "feed": search.rank(rows, query, top_k=top_k, stop_words=stop_words),
    }


def dashboard(feature_xml: DataFrame, **choices) -> dict[str, DataFrame]:
    """``panels`` straight from the feature XML."""
    return panels(dashboard_view(feature_xml), **choices)


def eda_report(eda: DataFrame, order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All tables of the exploratory report.

    With ``order``, the columns of the document order, the first date that can be read decides
    the format of all; without it each date is read by itself.
    """
    if order:
        dated, day = stats.with_inferred_days(eda, "published", order, "_day"), F.col("_day")
    else:
        dated, day = eda, any_date(F.col("published"))
    columns = ["cve_id", "vendor", "attack_type", "cvss_score", "severity", "published"]
    return {
        "total": stats.row_count(eda),
        "null_counts": stats.null_counts(eda, columns),
        "describe": stats.describe(eda, "cvss_score"),
        "attack_types": stats.value_counts(eda, "attack_type"),
        "top_vendors": stats.top_values(eda, "vendor"),
        "mean_by_attack": stats.mean_by(eda, "attack_type", "cvss_score"),
        "severities": stats.dense_counts(eda, "severity", SEVERITIES, "severity"),
        "undated": stats.any_null(dated, day),
        "timeline": stats.timeline(dated, day),
        "severity_by_attack": stats.dense_crosstab(
            eda,
            F.lower(F.coalesce(F.col("attack_type"), F.lit(""))),
            F.upper("severity"),
            TARGET_ATTACKS,
            SEVERITIES,
            "attack_type",
            "severity",
        ),
    }


def explanations(
    feature_xml: DataFrame,
    predict: Callable[[list[str]], list[str]],
    order: Sequence[str],
    limit: int | None = None,
) -> DataFrame:
    """All rows with a description, or the first ``limit``, each with the model's explanation."""
    chosen = first_n(explanation_input(feature_xml), order, limit)
    if limit:
        # A limit leaves one partition; the calls to the model should not queue up in it.
        chosen = chosen.repartition(chosen.sparkSession.sparkContext.defaultParallelism)
    text = enrich.prompt(F.col("cve_id"), F.col("attack_type"), F.col("description"))
    return enrich.explanation_rows(enrich.explain(chosen, text, predict))
