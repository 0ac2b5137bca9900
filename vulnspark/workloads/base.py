"""Registry of named queries, and SQL fragments shared by their twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vulnspark.functions.text import SPACE_CHARS


@dataclass(frozen=True)
class Workload:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


WORKLOADS: dict[str, Workload] = {}


def workload(name: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)`` under a name together with its SQL twin."""

    def register(run):
        if name in WORKLOADS:
            raise ValueError(f"duplicate workload {name}")
        WORKLOADS[name] = Workload(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int | None:
    """Tasks to deal the rows of a table to. Local test tables are single files of one row group, which one
    task would read; on a cluster tables have many files and stay as they are."""
    return spark.sparkContext.defaultParallelism if spark.sparkContext.master.startswith("local[") else None


# -- SQL fragments --------------------------------------------------------------

# The patterns for link labels, titles and vendors, the order in which versions are preferred and the
# names of the levels; the results of the twins hang on them.
SQL_WORD = r"[\p{L}\p{N}_]"
SQL_LINK = r"\[([^\]]+)\]\([^)]+\)"
SQL_VERSIONS = ("3.1", "3.0", "4.0", "2.0")
SQL_LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def sql_strip(x: str) -> str:
    return f"trim({x}, '{SPACE_CHARS}')"


def sql_squeeze(x: str) -> str:
    return sql_strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def sql_or_unknown(x: str) -> str:
    return f"coalesce(nullif({x}, ''), 'unknown')"


def sql_link_labels(x: str) -> str:
    replaced = rf"regexp_replace({x}, '{SQL_LINK}', '\1', 'g')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown' ELSE {replaced} END"


def sql_flat_text(x: str) -> str:
    one_line = rf"regexp_replace({x}, '[\r\n\t]+', ' ', 'g')"
    return f"coalesce({sql_strip(f"regexp_replace({one_line}, ' {{2,}}', ' ', 'g')")}, '')"


def sql_clean_title(x: str) -> str:
    w = SQL_WORD
    t = rf"regexp_replace({x}, '^Title:\s*', '')"
    t = f"coalesce(nullif({t}, ''), 'unknown')"
    t = rf"regexp_replace({t}, '{SQL_LINK}', '\1', 'g')"
    t = rf"regexp_replace({t}, '{w}+\.py($|[^\p{{L}}\p{{N}}_])', '\1', 'g')"
    t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])_[a-zA-Z0-9_]+($|[^\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '(?i)\b(injection)\b[^\n]*\binjection\b', '\1', 'g')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown' ELSE {sql_squeeze(t)} END"


def sql_vendor_name(x: str) -> str:
    bare = sql_strip(rf"regexp_replace(coalesce({x}, ''), '^[^\p{{L}}\p{{Nl}}\p{{No}}_]+', '')")
    return f"coalesce(nullif({bare}, ''), 'Unknown')"


def sql_title_case(x: str) -> str:
    runs = rf"regexp_extract_all(lower({x}), '\p{{L}}+|[^\p{{L}}]+')"
    return f"array_to_string(list_transform({runs}, lambda t: upper(t[1]) || t[2:]), '')"


def sql_iso_date(x: str) -> str:
    return f"CAST(try_strptime({x}, '%Y-%m-%d') AS DATE)"


def sql_number(x: str) -> str:
    pattern = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    text = sql_strip(x)
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN CAST({text} AS DOUBLE) END"


def sql_best_score(scores: str, versions: str) -> str:
    at = [f"{scores}[list_position({versions}, '{v}')]" for v in SQL_VERSIONS]
    return (
        f"coalesce(CASE WHEN len({scores}) = len({versions}) THEN coalesce({', '.join(at)}) END, "
        f"{scores}[1])"
    )


def sql_best_severity(severities: str, versions: str, scores: str) -> str:
    at = [f"{severities}[list_position({versions}, '{v}')]" for v in SQL_VERSIONS]
    known = ", ".join(
        f"CASE WHEN list_contains({severities}, '{s}') THEN '{s}' END"
        for s in SQL_LEVELS
    )
    return (
        f"coalesce(CASE WHEN len({severities}) = len({versions}) AND len({severities}) = len({scores}) "
        f"THEN coalesce({', '.join(at)}) END, {known}, {severities}[1])"
    )


def sql_level(x: str) -> str:
    return (
        f"CAST(CASE {x} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 "
        f"WHEN 'CRITICAL' THEN 4 END AS INTEGER)"
    )
