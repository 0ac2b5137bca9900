"""Advisory-shaped relations derived row by row from the test tables.

``raw_records`` reads ``documents`` and gives raw records with long texts,
missing parts, repeated ids and odd values. ``ratings`` reads ``lineitem`` and
gives ids with short lists of ratings. Both exist once as DataFrame and once as
SQL (``RAW_SQL``, ``RATINGS_SQL``).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.sources.scan import spread
from vulnspark.workloads.base import slots, table

CVSS_TYPE = "array<struct<score:string,severity:string,version:string,vector:string>>"


def _pick(values: list[str | None], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _score_text(tenths: Column) -> Column:
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with ``_seq`` as document order."""
    d, n = F.col("doc_id"), F.col("n_chars")
    sentence = F.substring_index("text", ".", 1)
    number = F.when(d % 10 == 9, d - 1).otherwise(d)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (d % 1500).cast("int"))
    later = F.date_add(day, 30)

    def rating(score: Column, severity: Column, version: Column, vector: Column) -> Column:
        return F.struct(
            score.alias("score"), severity.alias("severity"),
            version.alias("version"), vector.alias("vector"),
        )

    first = rating(
        F.when(d % 11 == 0, "n/a").otherwise(_score_text(n % 101)),
        _pick(["LOW", "Medium", "high", "CRITICAL", "-", "unknown"], d % 6),
        _pick(["3.1", "2.0", "4.0", "", None], d % 5),
        F.when(d % 2 == 0, "").otherwise(F.concat(F.lit("AV:"), F.col("lang"))),
    )
    second = rating(
        _score_text((n * 7) % 101),
        _pick(["HIGH", "none", "MEDIUM", ""], d % 4),
        _pick(["3.0", "3.1", "2.0"], d % 3),
        F.lit(None).cast("string"),
    )
    return spread(table(spark, sf_dir, "documents"), slots(spark)).select(
        d.alias("_seq"),
        F.when(d % 97 == 5, "unknown")
        .otherwise(F.concat(F.lit("CVE-2024-"), number.cast("string")))
        .alias("cve_id"),
        F.when(d % 8 == 0, None)
        .when(d % 8 == 1, F.concat(
            F.lit("Title: ["), sentence, F.lit("](http://a.b/c) run_"), d.cast("string"),
            F.lit(".py SQL Injection via  injection")))
        .when(d % 8 == 2, "Unknown")
        .otherwise(F.concat(F.lit("Title:  "), sentence, F.lit(" _priv"), d.cast("string")))
        .alias("title"),
        F.col("text").alias("description"),
        F.when(d % 13 == 0, "soon").otherwise(F.date_format(day, "yyyy-M-d")).alias("published_date"),
        F.when(d % 17 == 0, None).otherwise(F.date_format(later, "yyyy-MM-dd")).alias("last_modified_date"),
        F.when(d % 4 == 0, F.array().cast("array<string>"))
        .when(d % 4 == 1, F.array(F.lit("CWE-79: Cross")))
        .when(d % 4 == 2, F.array(F.lit("CWE-89: CWE-89: SQL"), F.lit("no match")))
        .otherwise(F.array(F.lit("CWE-20:Input|CWE-1: Pipe"), F.lit("CWE-22: Path  ")))
        .alias("cwe"),
        F.slice(F.array(first, second, first), F.lit(1), (d % 4).cast("int")).alias("cvss"),
        F.when(d % 9 == 0, "N/A ")
        .when(d % 9 == 1, None)
        .when(d % 9 == 2, F.concat(F.lit("3-"), F.col("source")))
        .when(d % 9 == 3, "PromtEngineer")
        .otherwise(F.concat(F.lit("  "), F.col("source"), F.lit(" inc ")))
        .alias("vendor"),
        F.concat(F.lit(" "), F.col("lang")).alias("product"),
        F.when(d % 3 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(
            F.concat(F.lit("affected at 1."), (d % 10).cast("string")), F.lit("affected at 2")))
        .alias("affected_versions"),
        F.when(d % 29 == 0, None)
        .otherwise(_pick(["prompt  injection", "SQL Injection", "Cross-Site Scripting", "buffer overflow"], F.floor(d / 3) % 4))
        .alias("attackType"),
    )


RAW_SQL = """
    SELECT d AS _seq,
      CASE WHEN d % 97 = 5 THEN 'unknown'
           ELSE 'CVE-2024-' || CAST(CASE WHEN d % 10 = 9 THEN d - 1 ELSE d END AS VARCHAR) END AS cve_id,
      CASE d % 8 WHEN 0 THEN NULL
        WHEN 1 THEN 'Title: [' || sentence || '](http://a.b/c) run_' || d || '.py SQL Injection via  injection'
        WHEN 2 THEN 'Unknown'
        ELSE 'Title:  ' || sentence || ' _priv' || d END AS title,
      text AS description,
      CASE WHEN d % 13 = 0 THEN 'soon' ELSE strftime(day, '%Y-%-m-%-d') END AS published_date,
      CASE WHEN d % 17 = 0 THEN NULL ELSE strftime(day + INTERVAL 30 DAY, '%Y-%m-%d') END AS last_modified_date,
      CASE d % 4 WHEN 0 THEN CAST([] AS VARCHAR[])
        WHEN 1 THEN ['CWE-79: Cross']
        WHEN 2 THEN ['CWE-89: CWE-89: SQL', 'no match']
        ELSE ['CWE-20:Input|CWE-1: Pipe', 'CWE-22: Path  '] END AS cwe,
      list_slice([a, b, a], 1, d % 4) AS cvss,
      CASE d % 9 WHEN 0 THEN 'N/A ' WHEN 1 THEN NULL WHEN 2 THEN '3-' || source
        WHEN 3 THEN 'PromtEngineer' ELSE '  ' || source || ' inc ' END AS vendor,
      ' ' || lang AS product,
      CASE WHEN d % 3 = 0 THEN CAST([] AS VARCHAR[])
           ELSE ['affected at 1.' || (d % 10), 'affected at 2'] END AS affected_versions,
      CASE WHEN d % 29 = 0 THEN NULL
           ELSE ['prompt  injection', 'SQL Injection', 'Cross-Site Scripting', 'buffer overflow'][((d // 3) % 4) + 1]
      END AS attackType
    FROM (
      SELECT *, doc_id AS d, split_part(text, '.', 1) AS sentence,
        CAST(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS DATE) AS day,
        {'score': CASE WHEN doc_id % 11 = 0 THEN 'n/a'
                  ELSE ((n_chars % 101) // 10) || '.' || ((n_chars % 101) % 10) END,
         'severity': ['LOW', 'Medium', 'high', 'CRITICAL', '-', 'unknown'][(doc_id % 6) + 1],
         'version': ['3.1', '2.0', '4.0', '', NULL][(doc_id % 5) + 1],
         'vector': CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'AV:' || lang END} AS a,
        {'score': ((n_chars * 7 % 101) // 10) || '.' || ((n_chars * 7 % 101) % 10),
         'severity': ['HIGH', 'none', 'MEDIUM', ''][(doc_id % 4) + 1],
         'version': ['3.0', '3.1', '2.0'][(doc_id % 3) + 1],
         'vector': CAST(NULL AS VARCHAR)} AS b
      FROM documents)
"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_key, cvss, and the columns they come from), 0 to 3 ratings per row."""
    k, line = F.col("l_partkey"), F.col("l_linenumber")
    tenths = (F.col("l_quantity") * 2).cast("bigint")

    def rating(score: Column, severity: Column, version: Column) -> Column:
        return F.struct(
            score.alias("score"), severity.alias("severity"), version.alias("version"),
            F.when(k % 3 == 0, "").when(k % 3 == 1, "AV:N").alias("vector"),
        )

    first = rating(
        _score_text(tenths),
        _pick(["low", "MEDIUM", "HIGH", "CRITICAL", "unknown"], k % 5),
        _pick(["3.1", "3.0", "2.0", ""], k % 4),
    )
    second = rating(
        F.when(k % 7 == 0, "x").otherwise(_score_text((tenths * 3) % 101)),
        _pick(["HIGH", "—", None], k % 3),
        _pick(["4.0", "3.1"], line % 2),
    )
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return spread(table(spark, sf_dir, "lineitem").select(*columns), slots(spark)).select(
        F.concat_ws("-", F.lit("CVE"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        F.slice(F.array(first, second, first), F.lit(1), (line % 4).cast("int")).alias("cvss"),
    )


RATINGS_SQL = """
    SELECT 'CVE-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_key,
      list_slice([a, b, a], 1, l_linenumber % 4) AS cvss
    FROM (
      SELECT *,
        {'score': (t // 10) || '.' || (t % 10),
         'severity': ['low', 'MEDIUM', 'HIGH', 'CRITICAL', 'unknown'][(l_partkey % 5) + 1],
         'version': ['3.1', '3.0', '2.0', ''][(l_partkey % 4) + 1],
         'vector': CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'AV:N' END} AS a,
        {'score': CASE WHEN l_partkey % 7 = 0 THEN 'x'
                  ELSE ((t * 3 % 101) // 10) || '.' || ((t * 3 % 101) % 10) END,
         'severity': ['HIGH', '—', NULL][(l_partkey % 3) + 1],
         'version': ['4.0', '3.1'][(l_linenumber % 2) + 1],
         'vector': CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'AV:N' END} AS b
      FROM (SELECT *, CAST(l_quantity * 2 AS BIGINT) AS t FROM lineitem))
"""

# Clean, nested and feature stages of the raw records, in SQL.
_FIRST_KEY = "x.version || chr(1) || coalesce(x.score, chr(2))"


def sql_clean_cvss(x: str) -> str:
    defaults = f"""list_transform({x}, lambda x: {{
        'score': x.score,
        'severity': CASE WHEN coalesce(x.severity, '') IN ('—', '-', '') THEN 'unknown' ELSE x.severity END,
        'version': coalesce(nullif(x.version, ''), 'unknown'),
        'vector': CASE WHEN x.vector = '' THEN 'unknown' ELSE x.vector END}})"""
    return defaults


def sql_first_per_key(x: str) -> str:
    key = "y.version || chr(1) || coalesce(y.score, chr(2))"
    keys = f"list_transform({x}, lambda y: {key})"
    return f"list_filter({x}, lambda x, i: list_position({keys}, {_FIRST_KEY}) = i)"
