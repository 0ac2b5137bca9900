"""Record stages: cleaning, reshaping, features, duplicates."""

from pyspark.sql import functions as F

from vulnspark.functions import nested, text
from vulnspark.operators.cleaning import clean_records, cwe_or_unknown
from vulnspark.operators.computed import where_computed
from vulnspark.operators.dedup import cap_per_group, keep_last
from vulnspark.operators.features import (
    build_features,
    is_blank_severity,
    quality_report,
    to_feature_xml,
)
from vulnspark.operators.pages import tag_and_union
from vulnspark.operators.reshape import nest_records
from vulnspark.operators.stats import summary, value_counts
from vulnspark.operators.views import dashboard_view, eda_view
from vulnspark.workloads import base
from vulnspark.workloads.base import table, workload
from vulnspark.workloads.derived import (
    RATINGS_SQL,
    RAW_SQL,
    ratings,
    raw_records,
    sql_clean_cvss,
    sql_first_per_key,
)


def rating_texts(cvss):
    """One text per rating, so that results compare as plain text."""
    return F.array_join(
        F.transform(
            cvss,
            lambda x: F.concat_ws(
                "/", *[F.coalesce(x[f], F.lit("~")) for f in ("score", "severity", "version", "vector")]
            ),
        ),
        ";",
    )


def sql_rating_texts(x: str) -> str:
    fields = " || '/' || ".join(f"coalesce(r.{f}, '~')" for f in ("score", "severity", "version", "vector"))
    return f"array_to_string(list_transform({x}, lambda r: {fields}), ';')"


# -- single rules over lists ------------------------------------------------------


@workload(
    "cvss_nested_clean",
    f"""SELECT row_key, {sql_rating_texts('deduplicated')} AS cvss, CAST(len(deduplicated) AS INTEGER) AS kept
        FROM (SELECT row_key, {sql_first_per_key('cleaned')} AS deduplicated
              FROM (SELECT row_key, {sql_clean_cvss('cvss')} AS cleaned FROM ({RATINGS_SQL})))""",
)
def cvss_nested_clean(spark, sf_dir):
    cleaned = ratings(spark, sf_dir).select("row_key", nested.clean_cvss(F.col("cvss")).alias("c"))
    return cleaned.select("row_key", rating_texts(F.col("c")).alias("cvss"), F.size("c").alias("kept"))


@workload(
    "cvss_array_dedup",
    f"""SELECT row_key, {sql_rating_texts('kept')} AS cvss
        FROM (SELECT row_key, list_filter(cvss, lambda x, i:
                list_position(list_transform(cvss, lambda y: coalesce(y.severity, '~')), coalesce(x.severity, '~')) = i) AS kept
              FROM ({RATINGS_SQL}))""",
)
def cvss_array_dedup(spark, sf_dir):
    kept = nested.first_per_key(F.col("cvss"), lambda x: F.coalesce(x["severity"], F.lit("~")))
    return ratings(spark, sf_dir).select("row_key", rating_texts(kept).alias("cvss"))


@workload(
    "cvss_independent_lists",
    f"""SELECT row_key, array_to_string(scores, '|') AS scores, array_to_string(severities, '|') AS severities,
          array_to_string(versions, '|') AS versions
        FROM (SELECT row_key,
          list_filter(list_transform(cvss, lambda x: CASE WHEN x.score = 'x' THEN NULL ELSE x.score END), lambda s: s IS NOT NULL) AS scores,
          list_transform(list_filter(cvss, lambda x: coalesce(x.severity, '') <> '' AND lower(x.severity) <> 'unknown'),
            lambda x: upper(x.severity)) AS severities,
          list_transform(list_filter(cvss, lambda x: coalesce(x.version, '') <> ''), lambda x: x.version) AS versions
          FROM ({RATINGS_SQL}))""",
)
def cvss_independent_lists(spark, sf_dir):
    c = F.col("cvss")
    return ratings(spark, sf_dir).select(
        "row_key",
        nested.joined(F.transform(nested.scores(c), lambda s: s.cast("string"))).alias("scores"),
        nested.joined(nested.severities(c)).alias("severities"),
        nested.joined(nested.non_blank(c, "version")).alias("versions"),
    )


_LISTS_SQL = f"""SELECT row_key, cvss,
          list_transform(list_filter(cvss, lambda x: x.score <> 'x'), lambda x: CAST(x.score AS DOUBLE)) AS scores,
          list_transform(list_filter(cvss, lambda x: coalesce(x.severity, '') <> '' AND lower(x.severity) <> 'unknown'),
            lambda x: upper(x.severity)) AS severities,
          list_transform(list_filter(cvss, lambda x: coalesce(x.version, '') <> ''), lambda x: x.version) AS versions
        FROM (SELECT row_key, list_transform(cvss, lambda r: {{
                'score': CASE WHEN r.score = 'x' THEN 'x' ELSE r.score END, 'severity': r.severity,
                'version': r.version}}) AS cvss FROM ({RATINGS_SQL}))"""


def _lists(spark, sf_dir):
    c = F.col("cvss")
    return ratings(spark, sf_dir).select(
        "row_key",
        nested.scores(c).alias("scores"),
        nested.severities(c).alias("severities"),
        nested.non_blank(c, "version").alias("versions"),
    )


@workload(
    "pick_best_score",
    f"""SELECT row_key, {base.sql_best_score('scores', 'versions')} AS cvss_score,
          CAST(({base.sql_best_score('scores', 'versions')}) IS NOT NULL AS INTEGER) AS has_cvss
        FROM ({_LISTS_SQL})""",
)
def pick_best_score(spark, sf_dir):
    best = nested.best_score(F.col("scores"), F.col("versions"))
    return (
        _lists(spark, sf_dir)
        .select("row_key", best.alias("cvss_score"))
        .withColumn("has_cvss", F.col("cvss_score").isNotNull().cast("int"))
    )


@workload(
    "pick_best_severity",
    f"""SELECT row_key, severity_level, {base.sql_level('severity_level')} AS severity_numeric
        FROM (SELECT row_key, {base.sql_best_severity('severities', 'versions', 'scores')} AS severity_level
              FROM ({_LISTS_SQL}))
        WHERE severity_level IS NOT NULL AND upper(severity_level) NOT IN ('', 'NONE')""",
)
def pick_best_severity(spark, sf_dir):
    best = nested.best_severity(F.col("severities"), F.col("versions"), F.col("scores"))
    rows = _lists(spark, sf_dir).select("row_key", best.alias("severity_level"))
    rated = where_computed(rows, ~is_blank_severity(F.col("severity_level")))
    return rated.withColumn(
        "severity_numeric", text.one_of_levels(F.col("severity_level"), nested.SEVERITIES)
    )


@workload(
    "max_score_with_label",
    f"""SELECT row_key, best.score AS cvss_score, best.severity AS severity
        FROM (SELECT row_key, list_filter(numbers, lambda x, i: x.score = top AND
                 list_position(list_transform(numbers, lambda y: y.score), top) = i)[1] AS best
              FROM (SELECT *, list_max(list_transform(numbers, lambda x: x.score)) AS top
                    FROM (SELECT row_key, list_transform(list_filter(cvss, lambda x: x.score <> 'x'),
                            lambda x: {{'score': CAST(x.score AS DOUBLE), 'severity': x.severity}}) AS numbers
                          FROM ({RATINGS_SQL}))))""",
)
def max_score_with_label(spark, sf_dir):
    best = nested.top_score(F.col("cvss"))
    return ratings(spark, sf_dir).select(
        "row_key", best["score"].alias("cvss_score"), best["severity"].alias("severity")
    )


@workload(
    "cwe_parse",
    r"""SELECT p_partkey, CAST(len(parsed) AS INTEGER) AS cwe_count,
          array_to_string(list_transform(parsed, lambda x: x.id), '|') AS cwe_ids,
          array_to_string(list_filter(list_transform(parsed, lambda x:
            trim(regexp_replace(x.name, '^CWE-[0-9]+[:\s]+', ''))), lambda x: x <> ''), '|') AS cwe_names,
          CASE WHEN len(cwe) = 0 THEN 'unknown'
               ELSE array_to_string(list_transform(parsed, lambda x: x.id || ': ' || x.name), '|') END AS shown
        FROM (SELECT p_partkey, cwe,
                list_transform(list_filter(cwe, lambda x: regexp_matches(x, '^CWE-[0-9]+:\s*[^\n]')), lambda x: {
                  'id': regexp_extract(x, '^(CWE-[0-9]+):\s*([^\n]+)', 1),
                  'name': regexp_extract(x, '^(CWE-[0-9]+):\s*([^\n]+)', 2)}) AS parsed
              FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[])
                      ELSE ['CWE-' || p_size || ': ' || p_type, 'CWE-' || p_size || ' ' || p_type,
                            'CWE-7:CWE-8:  ' || p_name, ' CWE-1: y'] END AS cwe FROM part))""",
)
def cwe_parse(spark, sf_dir):
    number = F.concat(F.lit("CWE-"), "p_size")
    some = F.array(
        F.concat(number, F.lit(": "), "p_type"),
        F.concat(number, F.lit(" "), "p_type"),
        F.concat(F.lit("CWE-7:CWE-8:  "), "p_name"),
        F.lit(" CWE-1: y"),
    )
    raw = F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")).otherwise(some)
    parsed = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw_cwe")).withColumn(
        "cwe", nested.parse_cwe(F.col("raw_cwe"))
    )
    ids = nested.non_blank(F.col("cwe"), "id")
    return parsed.select(
        "p_partkey",
        F.size(ids).alias("cwe_count"),
        nested.joined(ids).alias("cwe_ids"),
        nested.joined(nested.clean_cwe_names(nested.non_blank(F.col("cwe"), "name"))).alias("cwe_names"),
        cwe_or_unknown(parsed).alias("shown"),
    )


@workload(
    "versions_replace",
    """SELECT p_partkey, CASE WHEN len(found) = 0 THEN 'unknown'
         ELSE array_to_string(list_transform(found, lambda v: replace(v, 'affected at ', '')), '|') END AS versions
       FROM (SELECT p_partkey, list_filter(
               ['affected at ' || p_size || '.0', p_name, CASE WHEN p_partkey % 3 = 0 THEN p_brand
                 ELSE 'also affected at ' || p_brand END][(p_partkey % 2) + 1:],
               lambda v: contains(v, 'affected at')) AS found FROM part)""",
)
def versions_replace(spark, sf_dir):
    third = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(
        F.concat(F.lit("also affected at "), "p_brand")
    )
    items = F.array(F.concat(F.lit("affected at "), "p_size", F.lit(".0")), F.col("p_name"), third)
    some = F.slice(items, (F.col("p_partkey") % 2 + 1).cast("int"), F.lit(3))
    found = F.filter(some, lambda v: F.contains(v, F.lit("affected at")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", nested.joined(nested.clean_versions(found)).alias("versions")
    )


# -- whole stages -----------------------------------------------------------------

CLEAN_SQL = f"""
    SELECT _seq, {base.sql_or_unknown('cve_id')} AS cve_id, {base.sql_clean_title('title')} AS title,
      {base.sql_link_labels('description')} AS description,
      {base.sql_or_unknown('published_date')} AS published_date,
      {base.sql_or_unknown('last_modified_date')} AS last_modified_date,
      list_transform(list_filter(cwe, lambda x: regexp_matches(x, '^CWE-[0-9]+:\\s*[^\\n]')), lambda x: {{
        'id': regexp_extract(x, '^(CWE-[0-9]+):\\s*([^\\n]+)', 1),
        'name': regexp_extract(x, '^(CWE-[0-9]+):\\s*([^\\n]+)', 2)}}) AS cwe,
      {sql_first_per_key('cvss')} AS cvss,
      coalesce(nullif(CASE WHEN trim(vendor) = 'PromtEngineer' THEN 'PromptEngineer' ELSE trim(vendor) END, ''), 'unknown') AS vendor,
      coalesce(nullif(trim(product), ''), 'unknown') AS product,
      CASE WHEN len(affected_versions) = 0 THEN ['unknown']
           ELSE list_transform(affected_versions, lambda v: replace(v, 'affected at ', '')) END AS affected_versions,
      {base.sql_or_unknown('attackType')} AS attack_type
    FROM (SELECT * REPLACE ({sql_clean_cvss('cvss')} AS cvss) FROM ({RAW_SQL}))
"""

FLAT_SQL = f"""
    SELECT _seq, trim(cve_id) AS cve_id, {base.sql_strip('title')} AS title, {base.sql_strip('description')} AS description,
      trim(published_date) AS published, trim(last_modified_date) AS last_modified,
      CASE WHEN lower(trim(vendor)) = 'n/a' THEN 'unknown' ELSE trim(vendor) END AS vendor,
      trim(attack_type) AS attack_type,
      list_filter(list_transform(cwe, lambda x: trim(x.id)), lambda x: x <> '') AS cwe_ids,
      list_filter(list_transform(cwe, lambda x: trim(x.name)), lambda x: x <> '') AS cwe_names,
      list_transform(list_filter(cvss, lambda x: x.score <> 'n/a'), lambda x: CAST(x.score AS DOUBLE)) AS scores,
      list_transform(list_filter(cvss, lambda x: x.severity <> '' AND lower(x.severity) <> 'unknown'), lambda x: upper(x.severity)) AS severities,
      list_transform(list_filter(cvss, lambda x: x.version <> ''), lambda x: x.version) AS versions
    FROM ({CLEAN_SQL})
"""

FEATURES_SQL = f"""
    SELECT cve_id, {base.sql_flat_text('title')} AS title, vendor_clean,
      {base.sql_title_case(base.sql_squeeze('attack_type'))} AS attack_type_clean,
      {base.sql_iso_date('published')} AS published_dt, {base.sql_iso_date('last_modified')} AS last_modified_dt,
      CAST(year({base.sql_iso_date('published')}) AS INTEGER) AS year,
      {base.sql_best_score('scores', 'versions')} AS cvss_score, severity_level,
      {base.sql_level('severity_level')} AS severity_numeric,
      CAST(len(cwe_ids) AS INTEGER) AS cwe_count, array_to_string(cwe_ids, '|') AS cwe_ids,
      array_to_string(list_filter(list_transform(
        CASE WHEN len(cwe_names) = 0 THEN cwe_names ELSE string_split(array_to_string(cwe_names, '|'), '|') END,
        lambda x: trim(regexp_replace(x, '^CWE-[0-9]+[:\\s]+', ''))), lambda x: x <> ''), '|') AS cwe_names_clean,
      CAST(length({base.sql_flat_text('description')}) AS INTEGER) AS description_length,
      CAST(({base.sql_best_score('scores', 'versions')}) IS NOT NULL AS INTEGER) AS has_cvss,
      {base.sql_flat_text('description')} AS description
    FROM (SELECT *, {base.sql_best_severity('severities', 'versions', 'scores')} AS severity_level
          FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY _seq DESC) AS rank
                FROM (SELECT *, {base.sql_vendor_name('vendor')} AS vendor_clean FROM ({FLAT_SQL})
                      WHERE lower(cve_id) <> 'unknown' AND lower(description) <> 'unknown' AND lower(title) <> 'unknown')
                WHERE lower(vendor_clean) <> 'unknown')
          WHERE rank = 1)
    WHERE severity_level IS NOT NULL AND upper(severity_level) NOT IN ('', 'NONE')
"""
def _clean(spark, sf_dir):
    return clean_records(raw_records(spark, sf_dir))


def _features(spark, sf_dir):
    return build_features(nest_records(_clean(spark, sf_dir)), ["_seq"])


@workload(
    "clean_stage",
    f"""SELECT cve_id, title, description, published_date, last_modified_date, vendor, product, attack_type,
          array_to_string(list_transform(cwe, lambda x: x.id || ':' || x.name), '|') AS cwe,
          {sql_rating_texts('cvss')} AS cvss, array_to_string(affected_versions, '|') AS versions
        FROM ({CLEAN_SQL})""",
)
def clean_stage(spark, sf_dir):
    return _clean(spark, sf_dir).select(
        "cve_id", "title", "description", "published_date", "last_modified_date", "vendor",
        "product", "attack_type",
        F.array_join(F.transform("cwe", lambda x: F.concat_ws(":", x["id"], x["name"])), "|").alias("cwe"),
        rating_texts(F.col("cvss")).alias("cvss"),
        nested.joined(F.col("affected_versions")).alias("versions"),
    )


@workload(
    "clean_stage_legacy",
    f"""SELECT _seq, coalesce(nullif(vendor, ''), 'unknown') AS vendor,
          coalesce(nullif(last_modified_date, ''), 'unknown') AS product,
          array_to_string(CASE WHEN product = '' THEN ['unknown'] ELSE string_split(product, '') END, '|') AS versions
        FROM ({RAW_SQL})""",
)
def clean_stage_legacy(spark, sf_dir):
    rows = clean_records(raw_records(spark, sf_dir), legacy=True)
    return rows.select(
        "_seq", "vendor", "product", nested.joined(F.col("affected_versions")).alias("versions")
    )


@workload(
    "nested_stage",
    f"""SELECT _seq, trim(cve_id) AS cve_id, {base.sql_strip('title')} AS title, trim(published_date) AS published,
          CASE WHEN lower(trim(vendor)) = 'n/a' THEN 'unknown' ELSE trim(vendor) END AS vendor,
          array_to_string(list_transform(cwe, lambda x: trim(x.id) || ':' || trim(x.name)), '|') AS cwe,
          array_to_string(list_transform(cvss, lambda x: coalesce(trim(x.score), '') || '/' || coalesce(trim(x.severity), '')
            || '/' || coalesce(trim(x.version), '')), ';') AS cvss
        FROM ({CLEAN_SQL})""",
)
def nested_stage(spark, sf_dir):
    rows = nest_records(_clean(spark, sf_dir))
    return rows.select(
        "_seq", "cve_id", "title", F.col("dates.published").alias("published"), "vendor",
        F.array_join(F.transform("cwe_list.cwe", lambda x: F.concat_ws(":", x["id"], x["name"])), "|").alias("cwe"),
        F.array_join(
            F.transform("cvss_list.cvss", lambda x: F.concat_ws("/", x["score"], x["severity"], x["version"])), ";"
        ).alias("cvss"),
    )


def shown_features(rows):
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("published_dt", "last_modified_dt")})


@workload("feature_table", f"""
    SELECT * REPLACE (strftime(published_dt, '%Y-%m-%d') AS published_dt,
                      strftime(last_modified_dt, '%Y-%m-%d') AS last_modified_dt) FROM ({FEATURES_SQL})""")
def feature_table(spark, sf_dir):
    """Raw records to the 16-column feature table: clean, reshape, deduplicate, derive."""
    return shown_features(_features(spark, sf_dir))


@workload(
    "feature_summary",
    f"""SELECT count(*) AS rows, round(avg(cvss_score), 6) AS mean_score, round(avg(cwe_count), 6) AS mean_cwe_count,
          round(avg(description_length), 4) AS mean_length FROM ({FEATURES_SQL})""",
)
def feature_summary(spark, sf_dir):
    out = summary(
        _features(spark, sf_dir),
        {"mean_score": "cvss_score", "mean_cwe_count": "cwe_count", "mean_length": "description_length"},
    )
    return out.select(
        "rows", F.round("mean_score", 6).alias("mean_score"),
        F.round("mean_cwe_count", 6).alias("mean_cwe_count"),
        F.round("mean_length", 4).alias("mean_length"),
    )


@workload(
    "severity_distribution",
    f"SELECT severity_level, count(*) AS n FROM ({FEATURES_SQL}) GROUP BY 1",
)
def severity_distribution(spark, sf_dir):
    return value_counts(_features(spark, sf_dir), "severity_level")


@workload(
    "quality_report",
    f"""WITH flat AS (
          SELECT *, lower(cve_id) = 'unknown' OR lower(title) = 'unknown' OR lower(description) = 'unknown' AS unknown,
            lower({base.sql_vendor_name('vendor')}) = 'unknown' AS no_vendor,
            {base.sql_best_severity('severities', 'versions', 'scores')} AS level
          FROM ({FLAT_SQL})),
        latest AS (
          SELECT coalesce(upper(level) IN ('', 'NONE'), true) AS blank FROM (
            SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY _seq DESC) AS rank
            FROM flat WHERE NOT unknown AND NOT no_vendor) WHERE rank = 1)
        SELECT (SELECT count(*) FROM flat) AS loaded,
          (SELECT count(*) FROM flat WHERE unknown) AS unknown_dropped,
          (SELECT count(*) FROM flat WHERE NOT unknown AND no_vendor) AS vendor_dropped,
          (SELECT count(*) - count(DISTINCT cve_id) FROM flat WHERE NOT unknown AND NOT no_vendor) AS duplicates_dropped,
          (SELECT count(*) FROM latest WHERE blank) AS severity_dropped,
          (SELECT count(*) FROM latest WHERE NOT blank) AS remaining""",
)
def quality(spark, sf_dir):
    return quality_report(nest_records(_clean(spark, sf_dir)), ["_seq"])


@workload(
    "dashboard_rows",
    f"""SELECT cve_id, title, description, cvss_score,
          CASE WHEN severity_level = 'UNKNOWN' THEN 'Unknown' ELSE upper(severity_level[1]) || lower(severity_level[2:]) END AS severity,
          CASE WHEN attack_type_clean IN ('', 'Unknown') THEN 'N/A' ELSE attack_type_clean END AS attack_type,
          CASE WHEN cwe_ids = '' THEN 'N/A' ELSE replace(cwe_ids, '|', ', ') END AS cwe,
          vendor_clean AS vendor, coalesce(strftime(published_dt, '%Y-%m-%d'), 'N/A') AS published,
          coalesce(strftime(last_modified_dt, '%Y-%m-%d'), 'N/A') AS last_modified
        FROM (SELECT * REPLACE (CASE WHEN title = '' THEN 'N/A' ELSE title END AS title) FROM ({FEATURES_SQL}))""",
)
def dashboard_rows(spark, sf_dir):
    return dashboard_view(to_feature_xml(_features(spark, sf_dir)))


@workload(
    "eda_rows",
    f"""SELECT _seq, trim(cve_id) AS cve_id, vendor, trim(attack_type) AS attack_type, best.score AS cvss_score,
          best.severity AS severity, trim(published_date) AS published
        FROM (SELECT * REPLACE (CASE WHEN lower(trim(vendor)) = 'n/a' THEN 'unknown' ELSE trim(vendor) END AS vendor),
                list_filter(numbers, lambda x, i: x.score = list_max(list_transform(numbers, lambda y: y.score)) AND
                  list_position(list_transform(numbers, lambda y: y.score), list_max(list_transform(numbers, lambda y: y.score))) = i)[1] AS best
              FROM (SELECT *, list_transform(list_filter(cvss, lambda x: x.score <> 'n/a'), lambda x:
                      {{'score': CAST(x.score AS DOUBLE), 'severity': x.severity}}) AS numbers FROM ({CLEAN_SQL})))""",
)
def eda_rows(spark, sf_dir):
    return eda_view(nest_records(_clean(spark, sf_dir)))


# -- duplicates, caps, unions -------------------------------------------------------


@workload(
    "dedup_keep_last_user",
    """SELECT user_id, event_id, event_type, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
       WHERE rank = 1""",
)
def dedup_keep_last_user(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return keep_last(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@workload(
    "per_group_cap",
    """SELECT event_type, event_id FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events)
       WHERE rank <= 600""",
)
def per_group_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return cap_per_group(rows, ["event_type"], ["ts", "event_id"], 600).drop("ts")


# The event types that are parts of their own; all others, and those without a type, are one part.
_PARTS = ("click", "error", "purchase", "signup", "view")


@workload(
    "tagged_union_counts",
    f"""SELECT coalesce(part, 'all') AS "attackType", count(*) AS n FROM (
          SELECT CASE WHEN event_type IN {_PARTS} THEN event_type ELSE 'other' END AS part FROM events)
        GROUP BY GROUPING SETS ((part), ())""",
)
def tagged_union_counts(spark, sf_dir):
    """Every event type as a part of its own, tagged with its name."""
    events, kind = table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type")
    parts = {name: events.where(kind == name) for name in _PARTS}
    parts["other"] = events.where(~F.coalesce(kind.isin(*_PARTS), F.lit(False)))
    counts = tag_and_union(parts).rollup("attackType").agg(F.count("*").alias("n"))
    return counts.select(F.coalesce("attackType", F.lit("all")).alias("attackType"), "n")
