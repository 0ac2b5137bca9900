"""Text, date and marker rules over documents, parts, orders and suppliers."""

from pyspark.sql import functions as F

from vulnspark.functions import text
from vulnspark.operators.cleaning import VENDOR_CORRECTIONS
from vulnspark.operators.features import has_unknown
from vulnspark.operators.reshape import known_vendor
from vulnspark.operators.views import shown_severity, shown_weaknesses
from vulnspark.workloads import base
from vulnspark.workloads.base import table, workload


@workload(
    "clean_text_docs",
    f"""SELECT doc_id, cleaned, CAST(length(cleaned) AS INTEGER) AS cleaned_length
        FROM (SELECT doc_id, {base.sql_flat_text("text || chr(9) || chr(13) || lang || '  '")} AS cleaned
              FROM documents)""",
)
def clean_text_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cleaned = text.flat_text(F.concat("text", F.lit("\t\r"), "lang", F.lit("  ")))
    return docs.select("doc_id", cleaned.alias("cleaned")).withColumn(
        "cleaned_length", F.length("cleaned")
    )


@workload(
    "strip_leading_nonword",
    f"""SELECT p_partkey, {base.sql_vendor_name("p_size || '-- ' || p_name || ' '")} AS vendor,
          {base.sql_vendor_name("p_size || ' -'")} AS no_vendor
        FROM part""",
)
def strip_leading_nonword(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.vendor_name(F.concat(size, F.lit("-- "), "p_name", F.lit(" "))).alias("vendor"),
        text.vendor_name(F.concat(size, F.lit(" -"))).alias("no_vendor"),
    )


@workload(
    "title_case",
    f"""SELECT p_partkey, {base.sql_title_case(base.sql_squeeze("p_name || '  it''s cross-' || p_type || ' x2y'"))}
          AS attack_type FROM part""",
)
def title_case(spark, sf_dir):
    name = F.concat("p_name", F.lit("  it's cross-"), "p_type", F.lit(" x2y"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.attack_name(name).alias("attack_type")
    )


_MARKED_PART = (
    "'Title: [' || p_name || '](http://x/' || p_partkey || ') ' || lower(p_type) || '_run.py _load_' || p_size "
    "|| '  SQL Injection ' || p_brand || ' via injection now'"
)


@workload(
    "markdown_title_clean",
    f"""SELECT p_partkey, {base.sql_clean_title("t")} AS title, {base.sql_link_labels("t")} AS description
        FROM (SELECT p_partkey, CASE p_partkey % 10 WHEN 3 THEN NULL WHEN 4 THEN 'Title: '
                ELSE {_MARKED_PART} END AS t FROM part)""",
)
def markdown_title_clean(spark, sf_dir):
    marked = F.concat(
        F.lit("Title: ["), "p_name", F.lit("](http://x/"), "p_partkey", F.lit(") "),
        F.lower("p_type"), F.lit("_run.py _load_"), "p_size", F.lit("  SQL Injection "),
        "p_brand", F.lit(" via injection now"),
    )
    key = F.col("p_partkey") % 10
    titled = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key == 3, None).when(key == 4, "Title: ").otherwise(marked).alias("t")
    )
    return titled.select(
        "p_partkey",
        text.clean_title(F.col("t")).alias("title"),
        text.link_labels(F.col("t")).alias("description"),
    )


@workload(
    "null_markers",
    """SELECT doc_id,
         coalesce(nullif(m, ''), 'unknown') AS clean_form,
         coalesce(trim(m), '') AS xml_form,
         CASE WHEN lower(trim(m)) = 'n/a' THEN 'unknown' ELSE coalesce(trim(m), '') END AS vendor_form,
         CASE WHEN m IS NULL OR trim(m) IN ('', 'unknown', 'Unknown') THEN 'N/A' ELSE trim(m) END AS shown_form,
         CASE WHEN m IS NULL OR trim(m) IN ('', 'unknown', 'Unknown') THEN 'Unknown'
              WHEN trim(m) = 'N/A' THEN 'Unknown'
              ELSE upper(trim(m)[1]) || lower(trim(m)[2:]) END AS severity_form,
         CASE WHEN m IS NULL OR trim(m) IN ('', 'unknown', 'Unknown') THEN 'N/A'
              ELSE replace(trim(m), '|', ', ') END AS list_form
       FROM (SELECT d.doc_id,
               CASE WHEN l.quality IS NULL THEN NULL
                    ELSE ['', 'unknown', 'Unknown', 'UNKNOWN', 'N/A', ' high ', 'a|b'][(d.doc_id % 7) + 1] END AS m
             FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
)
def null_markers(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("", "unknown", "Unknown", "UNKNOWN", "N/A", " high ", "a|b")])
    m = F.when(F.col("quality").isNotNull(), F.get(kinds, (F.col("doc_id") % 7).cast("int")))
    marked = (
        table(spark, sf_dir, "documents")
        .select("doc_id")
        .join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
        .select("doc_id", m.alias("m"))
    )
    c = F.col("m")
    return marked.select(
        "doc_id",
        text.or_unknown(c).alias("clean_form"),
        text.or_empty(c).alias("xml_form"),
        text.or_empty(known_vendor(c)).alias("vendor_form"),
        text.present_or(c, "N/A").alias("shown_form"),
        shown_severity(c).alias("severity_form"),
        shown_weaknesses(c).alias("list_form"),
    )


@workload(
    "unknown_filter",
    """SELECT doc_id, lang, description FROM (
         SELECT d.doc_id, d.lang, CASE d.lang WHEN 'fr' THEN 'UNKNOWN' ELSE d.text END AS description,
           CASE WHEN l.quality IS NULL THEN 'Unknown' WHEN l.toxic = 1 THEN '' ELSE d.source END AS vendor
         FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       WHERE lower(description) <> 'unknown' AND lower(vendor) <> 'unknown'""",
)
def unknown_filter(spark, sf_dir):
    joined = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang", "source", "text")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
    )
    vendor = (
        F.when(F.col("quality").isNull(), "Unknown")
        .when(F.col("toxic") == 1, "")
        .otherwise(F.col("source"))
    )
    description = F.when(F.col("lang") == "fr", "UNKNOWN").otherwise(F.col("text"))
    rows = joined.select("doc_id", "lang", description.alias("description"), vendor.alias("vendor"))
    return rows.where(~has_unknown(["description", "vendor"])).select("doc_id", "lang", "description")


@workload(
    "vendor_corrections",
    """SELECT s_suppkey, coalesce(m.right_name, trim(s.vendor)) AS vendor, s.vendor AS uncorrected
       FROM (SELECT s_suppkey, ' ' || CASE WHEN n_regionkey = 1 THEN 'PromtEngineer' ELSE n_name END || ' ' AS vendor
             FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey) s
       LEFT JOIN (VALUES ('PromtEngineer', 'PromptEngineer')) m(wrong_name, right_name)
         ON trim(s.vendor) = m.wrong_name""",
)
def vendor_corrections(spark, sf_dir):
    name = F.when(F.col("n_regionkey") == 1, "PromtEngineer").otherwise(F.col("n_name"))
    vendors = (
        table(spark, sf_dir, "supplier")
        .join(
            table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left"
        )
        .select("s_suppkey", F.concat(F.lit(" "), name, F.lit(" ")).alias("uncorrected"))
    )
    return vendors.withColumn("vendor", text.correct(F.col("uncorrected"), VENDOR_CORRECTIONS))


@workload(
    "date_features",
    f"""SELECT o_orderkey, coalesce(strftime(d, '%Y-%m-%d'), '') AS published, CAST(year(d) AS INTEGER) AS year,
          d IS NULL AS undated
        FROM (SELECT o_orderkey, {base.sql_iso_date('s')} AS d FROM (
          SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%-m-%-d')
            WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T' WHEN 2 THEN ''
            WHEN 3 THEN strftime(o_orderdate, '%Y') || '-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s
          FROM orders))""",
)
def date_features(spark, sf_dir):
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    written = (
        F.when(k == 0, F.date_format(day, "yyyy-M-d"))
        .when(k == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T")))
        .when(k == 2, "")
        .when(k == 3, F.concat(F.date_format(day, "yyyy"), F.lit("-13-01")))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    dated = table(spark, sf_dir, "orders").select("o_orderkey", text.iso_date(written).alias("d"))
    return dated.select(
        "o_orderkey",
        F.coalesce(F.date_format("d", "yyyy-MM-dd"), F.lit("")).alias("published"),
        F.year("d").alias("year"),
        F.col("d").isNull().alias("undated"),
    )


@workload(
    "text_length",
    "SELECT doc_id, CAST(length(text) AS INTEGER) AS description_length FROM documents",
)
def text_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").alias("description_length")
    )


@workload(
    "number_coercion",
    f"""SELECT o_orderkey, {base.sql_number('s')} AS score, ({base.sql_number('s')}) IS NOT NULL AS has_score
        FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
            WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || 'd' WHEN 2 THEN ' .5 ' WHEN 3 THEN 'nan'
            WHEN 4 THEN '7.' ELSE '' END AS s FROM orders)""",
)
def number_coercion(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    whole = F.floor("o_totalprice").cast("string")
    written = (
        F.when(k == 0, whole)
        .when(k == 1, F.concat(whole, F.lit("d")))
        .when(k == 2, " .5 ")
        .when(k == 3, "nan")
        .when(k == 4, "7.")
        .otherwise("")
    )
    score = text.number(F.col("s"))
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", written.alias("s"))
        .select("o_orderkey", score.alias("score"), score.isNotNull().alias("has_score"))
    )
