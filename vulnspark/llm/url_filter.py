"""Judge URLs by rules and, where none fits, by a tree of path templates per host."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import col, stored

WILD = "*"


@dataclass(frozen=True)
class Settings:
    """A segment is kept as it is from ``support`` pages and ``share`` of its parent's pages on.

    Kept siblings whose continuation differs from their common one by ``likeness`` or
    less (total variation) merge. A template is rejected if its share of blocked pages
    among the labelled, smoothed by ``prior`` with the weight of ``strength`` pages,
    reaches ``purity``. Segments beyond ``depth`` are one last segment.
    """

    depth: int = 4
    support: int = 8
    share: float = 0.02
    likeness: float = 0.1
    prior: float = 0.5
    strength: float = 2.0
    purity: float = 0.8
    coverage: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and for one without ``://``; A-Z of the host become lower case."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest (rule, verdict) that fits; a rule is written ``host/path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _shape(segments: Column) -> Column:
    """What the following segments look like, however many different ones there are: digits and letters are all one."""
    digits = F.regexp_replace(F.array_join(segments, "/"), "[0-9]+", "0")
    return F.xxhash64(F.size(segments), F.regexp_replace(digits, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F0]+", "a"))


def _grown(rows: DataFrame, level: int, s: Settings) -> DataFrame:
    """Add one segment to every template: kept, merged with like siblings, or a wildcard."""
    at = ["host", "template"]
    rows = rows.withColumn("seg", F.get("segs", F.lit(level)))
    here = rows.filter("seg IS NOT NULL")
    parents = here.groupBy(*at).agg(F.sum("n").alias("all"))
    kept = (
        here.groupBy(*at, "seg").agg(F.sum("n").alias("own")).filter(F.col("own") >= s.support)
        .join(parents, at).filter(F.col("own") >= s.share * F.col("all")).select(*at, "seg", "own")
    )
    # How the kept branches go on: shape of the next segments, and the labels below.
    label = F.expr("stack(3, 'block', block, 'allow', allow, 'none', n - block - allow) AS (label, x)")
    onward = (
        here.withColumn("next", _shape(F.slice("segs", level + 2, s.depth + 1))).groupBy(*at, "seg", "next")
        .agg(*(F.sum(c).alias(c) for c in ("n", "block", "allow")))
        .select(*at, "seg", "next", label).filter("x > 0").join(kept, [*at, "seg"])
    )
    common = onward.groupBy(*at, "next", "label").agg(F.sum("x").alias("sum"))
    whole = kept.groupBy(*at).agg(F.sum("own").alias("kept_n"), F.count("*").alias("branches"))
    gaps = (
        onward.join(common, [*at, "next", "label"]).join(whole, at)
        .groupBy(*at, "seg").agg(
            F.sum(F.greatest(F.col("x") / F.col("own") - F.col("sum") / F.col("kept_n"), F.lit(0.0))).alias("gap"),
            F.max("branches").alias("branches"),
        )
    )
    named = gaps.select(
        *at, "seg", F.when((F.col("gap") <= s.likeness) & (F.col("branches") > 1), WILD).otherwise(F.col("seg")).alias("as")
    )
    grown = F.when(F.col("seg").isNull(), F.col("template")).otherwise(
        F.concat("template", F.lit("/"), F.coalesce("as", F.lit(WILD)))
    )
    return rows.join(named, [*at, "seg"], "left").withColumn("template", grown).drop("seg", "as")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", settings: Settings = Settings()
) -> DataFrame:
    """Per page: id, host, path, rule, verdict, template, purity.

    The rules label the pages they fit. All paths of a host form a tree; level by level
    its segments are kept, merged or replaced by a wildcard, and each page ends in
    one template. Where no rule fits, the verdict is ``block`` if the template's smoothed
    share of blocked pages among its labelled ones reaches ``settings.purity`` and enough of
    it is labelled; a template without labels is allowed.

    Counts run over all pages; equal (host, path) are counted together. A null url, and
    one without ``://``, has an empty host and path; repeated rows are each judged; an
    empty table gives an empty result.
    """
    urls = pages.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    parsed = stored(urls.select("id", host.alias("host"), path.alias("path")), "urls")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    split = F.split(F.substr("path", F.lit(2)), "/", settings.depth + 1)
    rows = parsed.groupBy("host", "path").agg(F.count("*").alias("n")).select(
        "host", "path", "n", rule.alias("rule"), says.alias("says"),
        F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(split).alias("segs"),
        F.lit("").alias("template"),
    )
    for verdict in ("block", "allow"):
        rows = rows.withColumn(verdict, F.when(F.col("says") == verdict, F.col("n")).otherwise(0))
    rows = stored(rows, "url_paths")
    for level in range(settings.depth + 1):
        rows = stored(_grown(rows, level, settings), "url_templates")
    labelled = F.sum("block") + F.sum("allow")
    purity = (F.sum("block") + settings.prior * settings.strength) / (labelled + settings.strength)
    templates = rows.groupBy("host", "template").agg(purity.alias("purity"), (labelled / F.sum("n")).alias("covered"))
    judged = rows.join(templates, ["host", "template"]).select(
        "host", "path", "rule", "template", "purity",
        F.coalesce(
            "says",
            F.when((F.col("purity") >= settings.purity) & (F.col("covered") >= settings.coverage), "block").otherwise("allow"),
        ).alias("verdict"),
    )
    return parsed.join(judged, ["host", "path"]).select(
        F.col("id").alias(id_col), "host", "path", "rule", "verdict", "template", "purity"
    )
