"""Clean records to the nested shape of the XML file."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import UNKNOWN, or_empty, strip


def known_vendor(vendor: Column) -> Column:
    """``n/a`` in any case is ``unknown``."""
    return F.when(F.lower(strip(vendor)) == "n/a", UNKNOWN).otherwise(vendor)


def nest_records(clean: DataFrame) -> DataFrame:
    """Dates, weaknesses and scores become groups; vector and versions are dropped."""
    c = F.col
    weaknesses = F.transform(
        F.filter("cwe", lambda x: x.isNotNull()),
        lambda x: F.struct(or_empty(x["id"]).alias("id"), or_empty(x["name"]).alias("name")),
    )
    ratings = F.transform(
        F.filter("cvss", lambda x: x.isNotNull()),
        lambda x: F.struct(
            or_empty(x["score"]).alias("score"),
            or_empty(x["severity"]).alias("severity"),
            or_empty(x["version"]).alias("version"),
        ),
    )
    return clean.select(
        *[c(x) for x in clean.columns if x.startswith("_")],
        or_empty(c("cve_id")).alias("cve_id"),
        or_empty(c("title")).alias("title"),
        or_empty(c("description")).alias("description"),
        F.struct(
            or_empty(c("published_date")).alias("published"),
            or_empty(c("last_modified_date")).alias("last_modified"),
        ).alias("dates"),
        or_empty(known_vendor(c("vendor"))).alias("vendor"),
        or_empty(c("product")).alias("product"),
        or_empty(c("attack_type")).alias("attack_type"),
        F.struct(weaknesses.alias("cwe")).alias("cwe_list"),
        F.struct(ratings.alias("cvss")).alias("cvss_list"),
    )
