"""Projections for the consumers: dashboard, exploratory report, explanations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions import nested, text

MISSING = "N/A"


def shown_severity(severity: Column) -> Column:
    """Capitalised severity, ``Unknown`` where there is none."""
    level = text.present_or(severity, text.UNKNOWN)
    return F.when(level == MISSING, "Unknown").otherwise(text.capitalize(level))


def shown_weaknesses(ids: Column) -> Column:
    """Pipe list to comma list."""
    return F.replace(text.present_or(ids, MISSING), F.lit("|"), F.lit(", "))


def dashboard_view(feature_xml: DataFrame) -> DataFrame:
    """Ten columns with ``N/A`` markers; rows without an id are left out."""
    c = F.col
    rows = feature_xml.select(
        *[c(x) for x in feature_xml.columns if x.startswith("_")],
        text.present_or(c("cve_id"), MISSING).alias("cve_id"),
        text.present_or(c("title"), MISSING).alias("title"),
        text.present_or(c("description_features.text"), MISSING).alias("description"),
        text.number(c("cvss_features.score")).alias("cvss_score"),
        shown_severity(c("cvss_features.severity_level")).alias("severity"),
        text.present_or(c("attack_type"), MISSING).alias("attack_type"),
        shown_weaknesses(c("cwe_features.cwe_ids")).alias("cwe"),
        text.present_or(c("vendor"), MISSING).alias("vendor"),
        text.present_or(c("dates.published"), MISSING).alias("published"),
        text.present_or(c("dates.last_modified"), MISSING).alias("last_modified"),
    )
    return rows.where(c("cve_id") != MISSING)


def display_format(results: DataFrame) -> DataFrame:
    """Text forms for a table: one decimal for the score, four for the relevance."""
    out = results.withColumn("cvss_score", text.fixed(F.col("cvss_score"), 1))
    if "relevance" in results.columns:
        out = out.withColumn("relevance", text.fixed(F.col("relevance"), 4))
    return out


def eda_view(nested_rows: DataFrame) -> DataFrame:
    """Six columns; the score is the highest one, the severity belongs to it."""
    c = F.col
    top = nested.top_score(c("cvss_list.cvss"))
    return nested_rows.select(
        *[c(x) for x in nested_rows.columns if x.startswith("_")],
        "cve_id",
        "vendor",
        "attack_type",
        top["score"].alias("cvss_score"),
        top["severity"].alias("severity"),
        c("dates.published").alias("published"),
    )


def explanation_input(feature_xml: DataFrame) -> DataFrame:
    """Fields for the prompt; rows without a description are left out.

    Only an absent element gets the default, an empty one stays empty.
    """
    c = F.col

    def absent_or(name: str, default: str) -> Column:
        return F.coalesce(c(name), F.lit(default))

    rows = feature_xml.select(
        *[c(x) for x in feature_xml.columns if x.startswith("_")],
        *[absent_or(x, "Unknown").alias(x) for x in ("cve_id", "title", "vendor", "attack_type")],
        absent_or("cvss_features.severity_level", "Unknown").alias("severity"),
        absent_or("cvss_features.score", MISSING).alias("score"),
        text.or_empty(c("description_features.text")).alias("description"),
    )
    return rows.where(c("description") != "")
