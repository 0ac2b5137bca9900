"""Nested advisories to the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vulnspark import schemas
from vulnspark.functions import nested, text
from vulnspark.operators.computed import where_computed
from vulnspark.operators.dedup import keep_last


def flatten(nested_rows: DataFrame) -> DataFrame:
    """Trimmed scalars, and independent lists of weaknesses and ratings."""
    c = F.col
    cwe, cvss = c("cwe_list.cwe"), c("cvss_list.cvss")
    return nested_rows.select(
        *[c(x) for x in nested_rows.columns if x.startswith("_")],
        *[
            text.or_empty(c(x)).alias(x)
            for x in ("cve_id", "title", "description", "vendor", "product", "attack_type")
        ],
        text.or_empty(c("dates.published")).alias("published"),
        text.or_empty(c("dates.last_modified")).alias("last_modified"),
        nested.non_blank(cwe, "id").alias("cwe_ids"),
        nested.non_blank(cwe, "name").alias("cwe_names"),
        nested.scores(cvss).alias("cvss_scores"),
        nested.severities(cvss).alias("cvss_severities"),
        nested.non_blank(cvss, "version").alias("cvss_versions"),
    )


def has_unknown(columns: Sequence[str]) -> Column:
    """True where one of the columns says ``unknown`` in any case."""
    flags = [text.is_unknown(F.col(c)) for c in columns]
    out = flags[0]
    for flag in flags[1:]:
        out = out | flag
    return out


def is_blank_severity(severity: Column) -> Column:
    return severity.isNull() | F.upper(severity).isin("", "NONE")


UNKNOWN_CHECKED = ("cve_id", "description", "title")


def normalized_vendor() -> Column:
    return text.vendor_name(F.col("vendor"))


def picked_severity() -> Column:
    return nested.best_severity(
        nested.split_pipes(F.col("cvss_severities")),
        nested.split_pipes(F.col("cvss_versions")),
        F.col("cvss_scores"),
    )


def add_features(flat: DataFrame) -> DataFrame:
    """The remaining derived columns of the feature table, in its final order."""
    c = F.col
    versions = nested.split_pipes(c("cvss_versions"))
    ids = nested.split_pipes(c("cwe_ids"))
    base = flat.select(
        "*",
        text.flat_text(c("title")).alias("title_clean"),
        text.flat_text(c("description")).alias("description_clean"),
        text.iso_date(c("published")).alias("published_dt"),
        text.iso_date(c("last_modified")).alias("last_modified_dt"),
        nested.best_score(c("cvss_scores"), versions).alias("cvss_score"),
    )
    return base.select(
        *[c(x) for x in flat.columns if x.startswith("_")],
        c("cve_id"),
        c("title_clean").alias("title"),
        c("vendor_clean"),
        text.attack_name(c("attack_type")).alias("attack_type_clean"),
        c("published_dt"),
        c("last_modified_dt"),
        F.year("published_dt").alias("year"),
        c("cvss_score"),
        c("severity_level"),
        text.one_of_levels(c("severity_level"), nested.SEVERITIES).alias("severity_numeric"),
        F.size(ids).alias("cwe_count"),
        nested.joined(c("cwe_ids")).alias("cwe_ids"),
        nested.joined(nested.clean_cwe_names(nested.split_pipes(c("cwe_names")))).alias(
            "cwe_names_clean"
        ),
        F.length("description_clean").alias("description_length"),
        c("cvss_score").isNotNull().cast("int").alias("has_cvss"),
        c("description_clean").alias("description"),
    )


class StepCounts:
    """What the steps of ``build_features`` drop, counted by the plan that writes the table.

    The counters travel with the tasks of that one run; nothing is computed twice. They
    are there once an action has run the plan, and count that run only. A task that runs
    again because its output was lost counts its rows again.
    """

    def __init__(self) -> None:
        self.read, self.latest, self.kept = (Observation(f"features-{n}") for n in ("read", "latest", "kept"))

    def rows(self) -> dict[str, int]:
        read, latest, kept = self.read.get, self.latest.get["n"], self.kept.get["n"]
        return {
            "loaded": read["loaded"], "unknown_dropped": read["unknown"], "vendor_dropped": read["no_vendor"],
            "duplicates_dropped": read["loaded"] - read["unknown"] - read["no_vendor"] - latest,
            "severity_dropped": latest - kept, "remaining": kept,
        }

    def report(self, spark: SparkSession) -> DataFrame:
        counts = self.rows()
        return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts))


def build_features(
    nested_rows: DataFrame, order: Sequence[str], keep: Sequence[str] = (), counts: StepCounts | None = None
) -> DataFrame:
    """Filter, normalise, deduplicate and derive: one exchange, by ``cve_id``.

    ``keep`` names columns that start with an underscore and stay beside the 16 of the table.

    Only the vendor is normalised ahead of the exchange because a filter needs
    it; the text work runs on the surviving rows.
    """
    named = flatten(nested_rows).withColumn("vendor_clean", normalized_vendor())
    if counts:
        unknown, no_vendor = has_unknown(UNKNOWN_CHECKED), text.is_unknown(F.col("vendor_clean"))
        named = named.observe(
            counts.read, F.count(F.lit(1)).alias("loaded"), F.count_if(unknown).alias("unknown"),
            F.count_if(~unknown & no_vendor).alias("no_vendor"),
        )
    known = where_computed(named, ~has_unknown([*UNKNOWN_CHECKED, "vendor_clean"]))
    latest = keep_last(known, ["cve_id"], order)
    if counts:
        latest = latest.observe(counts.latest, F.count(F.lit(1)).alias("n"))
    latest = latest.withColumn("severity_level", picked_severity())
    rated = where_computed(latest, ~is_blank_severity(F.col("severity_level")))
    if counts:
        rated = rated.observe(counts.kept, F.count(F.lit(1)).alias("n"))
    return add_features(rated).select(*keep, *schemas.FEATURES.fieldNames())


def quality_report(nested_rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows loaded, dropped per step and remaining, in one pass.

    The rows of an id shrink to one per task before the exchange: counters plus
    the severity flag of the last row.
    """
    flat = flatten(nested_rows)
    usable = ~F.col("unknown") & ~F.col("no_vendor")
    flagged = flat.select(
        "cve_id",
        *order,
        has_unknown(UNKNOWN_CHECKED).alias("unknown"),
        text.is_unknown(normalized_vendor()).alias("no_vendor"),
        is_blank_severity(picked_severity()).alias("blank"),
    )
    last = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    position = F.when(usable, last)
    per_id = flagged.groupBy("cve_id").agg(
        F.count("*").alias("loaded"),
        F.count_if("unknown").alias("unknown"),
        F.count_if(~F.col("unknown") & F.col("no_vendor")).alias("no_vendor"),
        F.count_if(usable).alias("usable"),
        F.max_by("blank", position).alias("blank"),
    )
    kept = F.col("usable") > 0
    return per_id.agg(
        F.coalesce(F.sum("loaded"), F.lit(0)).alias("loaded"),
        F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown_dropped"),
        F.coalesce(F.sum("no_vendor"), F.lit(0)).alias("vendor_dropped"),
        F.coalesce(F.sum(F.when(kept, F.col("usable") - 1)), F.lit(0)).alias("duplicates_dropped"),
        F.count_if(kept & F.col("blank")).alias("severity_dropped"),
        F.count_if(kept & ~F.col("blank")).alias("remaining"),
    )


def to_feature_xml(features: DataFrame) -> DataFrame:
    """Feature table to the nested, all-text shape of its XML file; null is empty.

    Columns that start with an underscore become attributes of the record.
    """

    def shown(name: str, alias: str | None = None) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias or name)

    return features.select(
        *[F.col(x) for x in features.columns if x.startswith("_")],
        shown("cve_id"),
        shown("title"),
        shown("vendor_clean", "vendor"),
        shown("attack_type_clean", "attack_type"),
        F.struct(
            shown("published_dt", "published"), shown("last_modified_dt", "last_modified")
        ).alias("dates"),
        shown("year"),
        F.struct(
            shown("cvss_score", "score"),
            shown("severity_level"),
            shown("severity_numeric"),
            shown("has_cvss"),
        ).alias("cvss_features"),
        F.struct(
            shown("cwe_count"), shown("cwe_ids"), shown("cwe_names_clean", "cwe_names")
        ).alias("cwe_features"),
        F.struct(
            shown("description_length", "length"), shown("description", "text")
        ).alias("description_features"),
    )
