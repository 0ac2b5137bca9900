"""Expressions over arrays of text and of structs.

A record's lists stay arrays all the way; they are joined to text only where a
sink needs it. No expression explodes rows, so none of them shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnspark.functions.text import (
    SPACE,
    is_unknown,
    number,
    or_unknown,
    strip,
)

# Order of preference among score versions, severities by rank.
PREFERRED_VERSIONS = ("3.1", "3.0", "4.0", "2.0")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
BLANK_SEVERITIES = ("—", "-", "")

CWE_ENTRY = rf"^(CWE-\p{{Nd}}+):{SPACE}*([^\n]+)"
CWE_PREFIX = rf"^CWE-\p{{Nd}}+(?::|{SPACE})+"


def texts(*values: str) -> Column:
    """A literal array of text."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def or_no_items(arr: Column, item_type: str = "string") -> Column:
    return F.coalesce(arr, F.array().cast(f"array<{item_type}>"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    A plain expression that mentions a value ten times holds ten copies of it as
    soon as the optimizer moves it into a filter.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_cvss(cvss: Column) -> Column:
    """Defaults for missing parts, then the first item per (version, score)."""

    def with_defaults(x: Column) -> Column:
        severity = F.coalesce(x["severity"], F.lit(""))
        return F.struct(
            x["score"].alias("score"),
            F.when(severity.isin(*BLANK_SEVERITIES), "unknown").otherwise(severity).alias("severity"),
            or_unknown(x["version"]).alias("version"),
            F.when(x["vector"] == "", "unknown").otherwise(x["vector"]).alias("vector"),
        )

    return first_per_key(
        F.transform(or_no_items(cvss, "struct<score:string,severity:string,version:string,vector:string>"),
                    with_defaults),
        lambda x: F.concat(x["version"], F.lit("\x00"), F.coalesce(x["score"], F.lit("\x01"))),
    )


def first_per_key(arr: Column, key) -> Column:
    """Keep the first element per key inside one array, in order."""
    keys = F.transform(arr, key)
    return let(
        F.struct(arr.alias("items"), keys.alias("keys")),
        lambda r: F.filter(
            r["items"], lambda x, i: F.array_position(r["keys"], F.get(r["keys"], i)) == i + 1
        ),
    )


def parse_cwe(cwe: Column) -> Column:
    """``CWE-n: name`` texts to (id, name); texts of another form are dropped."""
    parsed = F.transform(
        or_no_items(cwe),
        lambda x: F.struct(
            F.regexp_extract(x, CWE_ENTRY, 1).alias("id"),
            F.regexp_extract(x, CWE_ENTRY, 2).alias("name"),
        ),
    )
    return F.filter(parsed, lambda x: x["id"] != "")


def clean_versions(versions: Column) -> Column:
    """Drop the words ``affected at``; no versions give ``[unknown]``."""
    some = F.transform(versions, lambda v: F.replace(v, F.lit("affected at "), F.lit("")))
    return F.when(F.size(or_no_items(versions)) > 0, some).otherwise(texts("unknown"))


def non_blank(arr: Column, field: str) -> Column:
    """Trimmed values of one struct field, blanks removed."""
    values = F.transform(arr, lambda x: F.coalesce(strip(x[field]), F.lit("")))
    return or_no_items(F.filter(values, lambda v: v != ""))


def scores(cvss: Column) -> Column:
    """The scores that are numbers."""
    parsed = F.transform(cvss, lambda x: number(x["score"]))
    return or_no_items(F.filter(parsed, lambda s: s.isNotNull()), "double")


def severities(cvss: Column) -> Column:
    """Severities in upper case without blanks and unknowns."""
    known = F.filter(non_blank(cvss, "severity"), lambda s: ~is_unknown(s))
    return F.transform(known, F.upper)


def joined(arr: Column) -> Column:
    return F.array_join(arr, "|")


def split_pipes(arr: Column) -> Column:
    """Elements that hold a pipe themselves count as several."""
    return let(arr, lambda a: F.when(F.size(a) > 0, F.split(joined(a), r"\|")).otherwise(a))


def clean_cwe_names(names: Column) -> Column:
    """Names without a leading ``CWE-n`` and the colons or spaces behind it."""
    bare = F.transform(names, lambda x: strip(F.regexp_replace(x, CWE_PREFIX, "")))
    return F.filter(bare, lambda x: x != "")


def _preferred(values: Column, versions: Column, order: Sequence[str]) -> Column:
    """The value at the first place of the best-liked version."""
    ranks = F.array(*[F.lit(v) for v in order])
    places = F.transform(
        versions, lambda v, i: F.struct(F.array_position(ranks, v).alias("rank"), i.alias("i"))
    )
    best = F.array_min(F.filter(places, lambda p: p["rank"] > 0))
    return F.get(values, best["i"])


def best_score(
    score_list: Column, versions: Column, order: Sequence[str] = PREFERRED_VERSIONS
) -> Column:
    """Score of the first preferred version, else the first score.

    Versions and scores belong together only when both lists are equally long.
    """

    def pick(r: Column) -> Column:
        aligned = F.size(r["scores"]) == F.size(r["versions"])
        preferred = F.when(aligned, _preferred(r["scores"], r["versions"], order))
        return F.coalesce(preferred, F.get(r["scores"], F.lit(0)))

    return let(F.struct(score_list.alias("scores"), versions.alias("versions")), pick)


def best_severity(
    severity_list: Column,
    versions: Column,
    score_list: Column,
    order: Sequence[str] = PREFERRED_VERSIONS,
    levels: Sequence[str] = SEVERITIES,
) -> Column:
    """Severity of the first preferred version when all three lists are equally
    long, else the highest known level, else the first severity."""

    def pick(r: Column) -> Column:
        size = F.size(r["severities"])
        aligned = (size == F.size(r["versions"])) & (size == r["n_scores"])
        preferred = F.when(aligned, _preferred(r["severities"], r["versions"], order))
        highest = [
            F.when(F.array_contains(r["severities"], x), F.lit(x)) for x in reversed(levels)
        ]
        return F.coalesce(preferred, *highest, F.get(r["severities"], F.lit(0)))

    lists = F.struct(
        severity_list.alias("severities"),
        versions.alias("versions"),
        F.size(score_list).alias("n_scores"),
    )
    return let(lists, pick)


def top_score(cvss: Column) -> Column:
    """(score, severity) of the highest numeric score, the first one on ties."""
    ranked = F.transform(
        cvss,
        lambda x, i: F.struct(
            number(x["score"]).alias("score"), (-i).alias("rank"), x["severity"].alias("severity")
        ),
    )
    return F.array_max(F.filter(ranked, lambda x: x["score"].isNotNull()))


def first_or_null(arr: Column, index: int = 0) -> Column:
    return F.get(arr, F.lit(index))
