"""Cleaning of raw advisory records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.functions import nested, text

# Known vendor misspellings.
VENDOR_CORRECTIONS = {"PromtEngineer": "PromptEngineer"}


def clean_records(
    raw: DataFrame,
    corrections: Mapping[str, str] = VENDOR_CORRECTIONS,
    legacy: bool = False,
) -> DataFrame:
    """Raw records to clean records, one narrow projection.

    By default vendor, product and versions come from their own fields. With
    ``legacy`` the vendor stays uncorrected, the product shows the modification
    date and the versions are the single characters of the product.
    """
    c = F.col
    if legacy:
        vendor = c("vendor")
        product = c("last_modified_date")
        letters = F.split(c("product"), "")
        versions = F.when(text.is_empty(c("product")), nested.texts("unknown")).otherwise(letters)
    else:
        vendor = text.correct(c("vendor"), corrections)
        product = text.strip(c("product"))
        versions = nested.clean_versions(c("affected_versions"))
    return raw.select(
        *[c(x) for x in raw.columns if x.startswith("_")],
        text.or_unknown(c("cve_id")).alias("cve_id"),
        text.clean_title(c("title")).alias("title"),
        text.link_labels(c("description")).alias("description"),
        text.or_unknown(c("published_date")).alias("published_date"),
        text.or_unknown(c("last_modified_date")).alias("last_modified_date"),
        nested.parse_cwe(c("cwe")).alias("cwe"),
        nested.clean_cvss(c("cvss")).alias("cvss"),
        text.or_unknown(vendor).alias("vendor"),
        text.or_unknown(product).alias("product"),
        versions.alias("affected_versions"),
        text.or_unknown(c("attackType")).alias("attack_type"),
    )


def cwe_or_unknown(df: DataFrame, raw_list: str = "raw_cwe", parsed: str = "cwe"):
    """Rendering of the weakness list: ``unknown`` where the raw list was empty."""
    shown = F.array_join(F.transform(F.col(parsed), lambda x: F.concat_ws(": ", x["id"], x["name"])), "|")
    empty = F.size(nested.or_no_items(F.col(raw_list))) == 0
    return F.when(empty, text.UNKNOWN).otherwise(shown)
