"""Counts, summaries, distributions and filters."""

from pyspark.sql import functions as F

from vulnspark.functions.nested import SEVERITIES
from vulnspark.functions.text import iso_date
from vulnspark.operators import stats
from vulnspark.operators.filters import any_of, min_score
from vulnspark.operators.views import display_format
from vulnspark.plans.consumers import SEVERITY_DISPLAY, TARGET_ATTACKS
from vulnspark.workloads.base import table, workload


@workload("value_counts_event", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts_event(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "events"), "event_type")


@workload(
    "value_counts_source_top10",
    "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10",
)
def value_counts_source_top10(spark, sf_dir):
    return stats.top_values(table(spark, sf_dir, "documents"), "source")


@workload(
    "avg_value_by_event",
    """SELECT kind, round(avg(score), 6) AS mean FROM (
         SELECT CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind,
           CASE WHEN event_type = 'error' THEN NULL ELSE value END AS score FROM events)
       GROUP BY 1 HAVING avg(score) IS NOT NULL""",
)
def avg_value_by_event(spark, sf_dir):
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.when(kind != "view", kind).alias("kind"),
        F.when(kind != "error", F.col("value")).alias("score"),
    )
    return stats.mean_by(rows, "kind", "score").select("kind", F.round("mean", 6).alias("mean"))


@workload(
    "describe_value",
    """SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
         min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
         round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events""",
)
def describe_value(spark, sf_dir):
    out = stats.describe(table(spark, sf_dir, "events"), "value")
    rounded = {c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")}
    return out.withColumns(rounded)


@workload(
    "null_counts",
    """SELECT * FROM (VALUES
         ('doc_id', (SELECT count(*) FILTER (doc_id IS NULL) FROM j)),
         ('quality', (SELECT count(*) FILTER (quality IS NULL) FROM j)),
         ('toxic', (SELECT count(*) FILTER (toxic IS NULL) FROM j)),
         ('lang', (SELECT count(*) FILTER (lang IS NULL) FROM j))) t("column", nulls)""".replace(
        "FROM j)", "FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id)))"
    ),
)
def null_counts(spark, sf_dir):
    joined = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
    )
    return stats.null_counts(joined, ["doc_id", "quality", "toxic", "lang"])


@workload(
    "dense_priority_counts",
    """SELECT level, count(o_orderkey) AS n FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) d(level)
       LEFT JOIN orders ON substr(o_orderpriority, 3) = level GROUP BY 1""",
)
def dense_priority_counts(spark, sf_dir):
    severity = F.col("o_orderpriority").substr(F.lit(3), F.lit(20))
    return stats.dense_counts(table(spark, sf_dir, "orders"), severity, SEVERITIES, "level")


_ATTACK_OF_STATUS = """CASE o_orderstatus WHEN 'F' THEN 'SQL Injection' WHEN 'O' THEN 'buffer overflow'
    WHEN 'P' THEN NULL END"""


@workload(
    "priority_status_crosstab",
    f"""SELECT attack_type, severity, count(o_orderkey) AS n
        FROM (VALUES ('buffer overflow'), ('sql injection'), ('prompt injection'), ('cross-site scripting')) a(attack_type)
        CROSS JOIN (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) s(severity)
        LEFT JOIN orders ON lower(coalesce({_ATTACK_OF_STATUS}, '')) = attack_type
          AND upper(lower(substr(o_orderpriority, 3))) = severity
        GROUP BY 1, 2""",
)
def priority_status_crosstab(spark, sf_dir):
    status = F.col("o_orderstatus")
    attack = F.when(status == "F", "SQL Injection").when(status == "O", "buffer overflow")
    severity = F.lower(F.col("o_orderpriority").substr(F.lit(3), F.lit(20)))
    return stats.dense_crosstab(
        table(spark, sf_dir, "orders"),
        F.lower(F.coalesce(attack, F.lit(""))),
        F.upper(severity),
        TARGET_ATTACKS,
        SEVERITIES,
        "attack_type",
        "severity",
    )


_DAY_TEXT_SQL = "CASE WHEN event_type = 'error' THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END"


def _day_text():
    return F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))


@workload(
    "daily_events",
    f"""SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n
        FROM (SELECT CAST(try_strptime({_DAY_TEXT_SQL}, '%Y-%m-%d') AS DATE) AS day FROM events)
        WHERE day IS NOT NULL GROUP BY 1""",
)
def daily_events(spark, sf_dir):
    days = stats.timeline(table(spark, sf_dir, "events"), iso_date(_day_text()))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@workload(
    "any_undated_event",
    f"SELECT bool_or(try_strptime({_DAY_TEXT_SQL}, '%Y-%m-%d') IS NULL) AS any_null FROM events",
)
def any_undated_event(spark, sf_dir):
    return stats.any_null(table(spark, sf_dir, "events"), iso_date(_day_text()))


@workload(
    "kpi_orders",
    """SELECT count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-urgent",
         count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-high",
         count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "3-medium",
         printf('%.1f', avg(o_totalprice)) AS mean_score FROM orders""",
)
def kpi_orders(spark, sf_dir):
    levels = ("1-URGENT", "2-HIGH", "3-MEDIUM")
    return stats.key_figures(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", levels
    )


@workload(
    "ordered_severity_counts",
    """SELECT severity, count(*) AS n FROM (
         SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
           WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Unknown' END AS severity FROM orders)
       GROUP BY 1""",
)
def ordered_severity_counts(spark, sf_dir):
    p = F.col("o_orderpriority")
    severity = (
        F.when(p == "1-URGENT", "Critical").when(p == "2-HIGH", "High")
        .when(p == "3-MEDIUM", "Medium").when(p == "5-LOW", "Low").otherwise("Unknown")
    )
    rows = table(spark, sf_dir, "orders").select(severity.alias("severity"))
    return stats.ordered_counts(rows, "severity", SEVERITY_DISPLAY)


@workload(
    "share_by_segment",
    """SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
       FROM customer GROUP BY 1""",
)
def share_by_segment(spark, sf_dir):
    out = stats.shares(table(spark, sf_dir, "customer"), "c_mktsegment")
    return out.withColumn("share", F.round("share", 6))


@workload(
    "histogram_quantity",
    """SELECT CASE WHEN l_quantity = 30 THEN 25.0::DOUBLE ELSE floor(l_quantity / 5.0::DOUBLE) * 5.0::DOUBLE END AS bin_start, count(*) AS n
       FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1""",
)
def histogram_quantity(spark, sf_dir):
    """Named range 10 to 30, with values on both sides of it."""
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 5.0, 10.0, 30.0)


def _fitted_sql(table_name: str, column: str) -> str:
    return f"""
    WITH rows AS (SELECT CAST({column} AS DOUBLE) AS x FROM {table_name} WHERE {column} IS NOT NULL),
    ends AS (SELECT min(x) AS lo, max(x) AS hi FROM rows),
    widths AS (SELECT lo, hi, unnest([1.0, 2.0, 5.0, 10.0, 20.0]::DOUBLE[]) * pow(10.0::DOUBLE, floor(log10((hi - lo) / 20))) AS w FROM ends),
    chosen AS (SELECT lo, hi, min(w) AS w FROM widths WHERE ceil(hi / w) - floor(lo / w) <= 20 GROUP BY lo, hi)
    SELECT greatest(least(floor(x / w), ceil(hi / w) - 1), floor(lo / w)) * w AS bin_start, w AS bin_width, count(*) AS n
    FROM rows CROSS JOIN chosen GROUP BY 1, 2"""


@workload("fitted_histogram_quantity", _fitted_sql("lineitem", "l_quantity"))
def fitted_histogram_quantity(spark, sf_dir):
    return stats.fitted_histogram(table(spark, sf_dir, "lineitem"), "l_quantity")


@workload("fitted_histogram_totalprice", _fitted_sql("orders", "o_totalprice"))
def fitted_histogram_totalprice(spark, sf_dir):
    return stats.fitted_histogram(table(spark, sf_dir, "orders"), "o_totalprice")


# Dates in three orders; the first row that has one decides.
_ORDERS_SQL = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'soon' WHEN 2 THEN NULL
    ELSE strftime(o_orderdate, '%d/%m/%Y') END"""


@workload(
    "inferred_timeline",
    f"""WITH rows AS (SELECT o_orderkey, {_ORDERS_SQL} AS t FROM orders),
        seen AS (SELECT o_orderkey, t, CASE WHEN try_strptime(t, '%Y-%m-%d') IS NOT NULL THEN '%Y-%m-%d'
                   WHEN try_strptime(t, '%m/%d/%Y') IS NOT NULL THEN '%m/%d/%Y'
                   WHEN try_strptime(t, '%d/%m/%Y') IS NOT NULL THEN '%d/%m/%Y' END AS f FROM rows),
        chosen AS (SELECT arg_min(f, o_orderkey) AS f FROM seen WHERE f IS NOT NULL),
        days AS (SELECT CASE WHEN chosen.f = '%Y-%m-%d' THEN try_strptime(t, '%Y-%m-%d')
                   WHEN chosen.f = '%m/%d/%Y' THEN try_strptime(t, '%m/%d/%Y') ELSE try_strptime(t, '%d/%m/%Y') END AS d FROM rows CROSS JOIN chosen)
        SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM days WHERE d IS NOT NULL GROUP BY 1""",
)
def inferred_timeline(spark, sf_dir):
    """Orders per day where days are texts in several formats: that of the first readable one counts."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    texts = F.when(key % 5 == 0, F.date_format(date, "yyyy-MM-dd")).when(key % 5 == 1, "soon").when(key % 5 > 2, F.date_format(date, "dd/MM/yyyy"))
    rows = table(spark, sf_dir, "orders").select(key, texts.alias("t"))
    dated = stats.with_inferred_days(rows, "t", ["o_orderkey"])
    return stats.timeline(dated, F.col("day")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@workload(
    "score_bands",
    """SELECT count(*) FILTER (l_quantity / 5 >= 9) AS at_least_9, count(*) FILTER (l_quantity / 5 >= 7) AS at_least_7
       FROM lineitem""",
)
def score_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 5).alias("score"))
    return stats.at_least(rows, "score", (9.0, 7.0))


@workload(
    "top_combined_flags",
    """SELECT cwe, count(*) AS n FROM (
         SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'N/A' ELSE l_returnflag || ', ' || l_linestatus END AS cwe
         FROM lineitem) WHERE cwe <> 'N/A' GROUP BY 1 ORDER BY n DESC, cwe LIMIT 10""",
)
def top_combined_flags(spark, sf_dir):
    flags = F.replace(F.concat_ws("|", "l_returnflag", "l_linestatus"), F.lit("|"), F.lit(", "))
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(flags == "R, O", "N/A").otherwise(flags).alias("cwe")
    )
    return stats.top_present(rows, "cwe")


@workload(
    "explode_top_words",
    """SELECT vendor, count(*) AS n FROM (
         SELECT trim(unnest(string_split(p_type || ', ' || p_name || CASE WHEN p_size > 40 THEN ', N/A' ELSE '' END, ', '))) AS vendor
         FROM part) WHERE vendor <> 'N/A' GROUP BY 1 ORDER BY n DESC, vendor LIMIT 10""",
)
def explode_top_words(spark, sf_dir):
    missing = F.when(F.col("p_size") > 40, ", N/A").otherwise("")
    rows = table(spark, sf_dir, "part").select(
        F.concat("p_type", F.lit(", "), "p_name", missing).alias("vendor")
    )
    return stats.exploded_counts(rows, "vendor").limit(10)


@workload(
    "filters_orders",
    """SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
         AND lower(o_orderstatus) IN ('f', 'o')
         AND coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END, 0) >= 150000""",
)
def filters_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    rows = any_of(rows, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    rows = any_of(rows, "o_orderstatus", ["f", "O"], case_insensitive=True)
    price = F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice"))
    return min_score(rows.withColumn("price", price), "price", 150000.0).select("o_orderkey")


@workload(
    "filters_off",
    """SELECT o_orderkey, printf('%.1f', o_totalprice) AS cvss_score, printf('%.4f', o_totalprice / 1024) AS relevance
       FROM orders""",
)
def filters_off(spark, sf_dir):
    """Empty lists and a minimum of 0 keep every row; shown with fixed decimals."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("cvss_score"),
        (F.col("o_totalprice") / 1024).alias("relevance"),
    )
    kept = min_score(any_of(rows, "o_orderpriority", []), "cvss_score", 0.0)
    return display_format(kept).select("o_orderkey", "cvss_score", "relevance")


@workload(
    "table_shape",
    "SELECT count(*) AS rows, 'doc_id, text, lang, source, n_chars' AS columns FROM documents",
)
def table_shape(spark, sf_dir):
    return stats.shape(table(spark, sf_dir, "documents"))


@workload(
    "table_preview",
    "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 3",
)
def table_preview(spark, sf_dir):
    return stats.preview(
        table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"]
    )
