"""Round trips through the file formats, in the cluster's shared folder."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark import jobs, schemas
from vulnspark.functions.nested import joined
from vulnspark.operators import search
from vulnspark.operators.cleaning import clean_records
from vulnspark.operators.features import StepCounts, build_features, flatten, to_feature_xml
from vulnspark.operators.reshape import nest_records
from vulnspark.operators.views import dashboard_view
from vulnspark.session import scratch_path
from vulnspark.sources import read_records, read_xml, write_records, write_xml
from vulnspark.workloads import explain, records, relevance
from vulnspark.workloads.base import WORKLOADS, table, workload
from vulnspark.workloads.derived import RAW_SQL, raw_records


def _shown_records(back):
    return back.select(
        "cve_id", "title", "description", "published_date", "last_modified_date", "vendor", "product",
        "attackType", joined(F.col("cwe")).alias("cwe"), joined(F.col("affected_versions")).alias("versions"),
        records.rating_texts(F.col("cvss")).alias("cvss"),
    )


@workload(
    "json_round_trip",
    f"""SELECT cve_id, title, description, published_date, last_modified_date, vendor, product, "attackType",
          array_to_string(cwe, '|') AS cwe, array_to_string(affected_versions, '|') AS versions,
          {records.sql_rating_texts('cvss')} AS cvss FROM ({RAW_SQL})""",
)
def json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "records-json")
    write_records(raw_records(spark, sf_dir).drop("_seq"), path)
    return _shown_records(read_records(spark, path, schemas.RAW_RECORD))


@workload(
    "xml_round_trip",
    f"""SELECT cve_id, title, description, published, last_modified, vendor, attack_type,
          array_to_string(cwe_ids, '|') AS cwe_ids, array_to_string(cwe_names, '|') AS cwe_names,
          CAST(len(scores) AS INTEGER) AS n_scores, array_to_string(severities, '|') AS severities,
          array_to_string(versions, '|') AS versions FROM ({records.FLAT_SQL})""",
)
def xml_round_trip(spark, sf_dir):
    path = scratch_path(spark, "nested-xml")
    write_xml(nest_records(clean_records(raw_records(spark, sf_dir))).drop("_seq"), path)
    back = flatten(read_xml(spark, path, schemas.RAW_XML))
    return back.select(
        "cve_id", "title", "description", "published", "last_modified", "vendor", "attack_type",
        joined(F.col("cwe_ids")).alias("cwe_ids"), joined(F.col("cwe_names")).alias("cwe_names"),
        F.size("cvss_scores").alias("n_scores"), joined(F.col("cvss_severities")).alias("severities"),
        joined(F.col("cvss_versions")).alias("versions"),
    )


@workload("feature_xml_round_trip", "SELECT * FROM (" + WORKLOADS["dashboard_rows"].sql + ")")
def feature_xml_round_trip(spark, sf_dir):
    """Feature table to XML and back to the dashboard's rows."""
    path = scratch_path(spark, "features-xml")
    features = build_features(nest_records(clean_records(raw_records(spark, sf_dir))), ["_seq"])
    write_xml(to_feature_xml(features), path)
    back = read_xml(spark, path, schemas.FEATURE_XML, encoding="auto", on_error="empty")
    return dashboard_view(back)


def _read_explanations(spark, path):
    back = read_xml(spark, path, schemas.EXPLANATIONS)
    return back.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in back.columns))


@workload("explanations_xml_round_trip", WORKLOADS["explanation_rows"].sql)
def explanations_xml_round_trip(spark, sf_dir):
    """A feature XML file explained as a whole; the explanations written as XML and read back."""
    path = scratch_path(spark, "explanations-xml")
    write_xml(explain.explanation_rows(spark, sf_dir), path, root_tag="cve_explanations")
    return _read_explanations(spark, path)


@workload("all_explanations_xml_round_trip", WORKLOADS["all_explanation_rows"].sql)
def all_explanations_xml_round_trip(spark, sf_dir):
    """Explanations of every row with a description, written as XML and read back."""
    path = scratch_path(spark, "all-explanations-xml")
    write_xml(explain.all_explanation_rows(spark, sf_dir), path, root_tag="cve_explanations")
    return _read_explanations(spark, path)


# -- files as others write them ---------------------------------------------------

# What stands around and in the records of a file, by remainder: comments with records in them, CDATA with tags and
# marks in it, instructions, longer names, attributes, empty elements.
_BEFORE = (
    "", "<!-- <vulnerability><cve_id>hidden</cve_id></vulnerability> -->", "<?note <vulnerability> ?>",
    "<vulnerability_count>3</vulnerability_count>", "<![CDATA[<vulnerability>]]>",
)
_TITLES = (
    "plain", "<![CDATA[a <!-- b]]>", "a --> b", "<![CDATA[<vulnerability> & </vulnerability>]]>", "x<!-- <vulnerability> -->y",
    "x<?p </vulnerability>?>y", "&lt;b&gt; &amp; &#233;",
)
_READ_TITLES = ("plain", "a <!-- b", "a --> b", "<vulnerability> & </vulnerability>", "xy", "xy", "<b> & é")
_OPENINGS = ("<vulnerability>", "<vulnerability a='1>2'>", '<vulnerability b="/>" >')


def _choice(values, index):
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def _sql_choice(values, index):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{index} + 1]"


@workload(
    "xml_odd_files",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS cve_id, {_sql_choice(_READ_TITLES, f"p_partkey % {len(_READ_TITLES)}")} AS title,
          p_name AS description FROM part""",
)
def xml_odd_files(spark, sf_dir):
    """Records in files full of comments, CDATA sections, instructions and tags with longer names."""
    path, key = scratch_path(spark, "odd-xml"), F.col("p_partkey")
    lines = F.concat(
        _choice(_BEFORE, key % len(_BEFORE)), _choice(_OPENINGS, key % len(_OPENINGS)), F.lit("<cve_id>"), key.cast("string"),
        F.lit("</cve_id>\n<title>"), _choice(_TITLES, key % len(_TITLES)), F.lit("</title><vulnerability_x/><description><![CDATA["),
        F.col("p_name"), F.lit("]]></description></vulnerability >"), F.when(key % 4 == 0, "<!-- </vulnerability> -->").otherwise(""),
    )
    table(spark, sf_dir, "part").select(lines.alias("value")).write.text(path)
    return read_xml(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("cve_id", "title", "description")]))


@workload("json_array_round_trip", WORKLOADS["json_round_trip"].sql)
def json_array_round_trip(spark, sf_dir):
    """Raw records as JSON arrays, one per file, and back."""
    path = scratch_path(spark, "records-array")
    write_records(raw_records(spark, sf_dir).drop("_seq"), path, array=True)
    return _shown_records(read_records(spark, path, schemas.RAW_RECORD, array=True))


@workload(
    "clean_json_array_round_trip",
    "SELECT cve_id, title, description, published_date, last_modified_date, vendor, product, attack_type FROM (" + records.CLEAN_SQL + ")",
)
def clean_json_array_round_trip(spark, sf_dir):
    """Clean records as JSON arrays, and back."""
    path = scratch_path(spark, "clean-array")
    write_records(clean_records(raw_records(spark, sf_dir)).drop("_seq"), path, array=True)
    back = read_records(spark, path, schemas.CLEAN_RECORD, array=True)
    return back.select("cve_id", "title", "description", "published_date", "last_modified_date", "vendor", "product", "attack_type")


@workload("staged_feature_table", WORKLOADS["feature_table"].sql)
def staged_feature_table(spark, sf_dir):
    """The feature table by the jobs, one after the other over files: JSON arrays, JSON arrays, XML, Parquet.

    The raw files carry no numbers; of the records of an id the one that stands last in them counts.
    """
    base = scratch_path(spark, "stages")
    raw = raw_records(spark, sf_dir).orderBy("_seq").drop("_seq")
    write_records(raw, f"{base}/raw")
    steps = [
        ("clean", "raw", "clean", ["--to-array"]), ("nest", "clean", "nested", ["--array"]),
        ("features", "nested", "features", ["--parquet", f"{base}/table"]),
    ]
    for job, source, target, options in steps:
        a = jobs.parser().parse_args([job, f"{base}/{source}", f"{base}/{target}", *options])
        a.run(spark, a)
    return records.shown_features(spark.read.parquet(f"{base}/table").select(*schemas.FEATURES.fieldNames()))


@workload("observed_quality", WORKLOADS["quality_report"].sql)
def observed_quality(spark, sf_dir):
    """The counters of the run that writes the feature table."""
    counts = StepCounts()
    raw = raw_records(spark, sf_dir)
    build_features(nest_records(clean_records(raw)), ["_seq"], counts=counts).write.parquet(scratch_path(spark, "counted-features"))
    return counts.report(spark)


@workload("stored_index_search", WORKLOADS["tfidf_search_all"].sql)
def stored_index_search(spark, sf_dir):
    """Build the index tables once, then search them."""
    path = scratch_path(spark, "index")
    docs = table(spark, sf_dir, "documents").select(*relevance.FIELDS)
    index = search.TfidfIndex.build(
        docs, "doc_id", search.corpus_text(relevance.FIELDS), path, relevance.STOP_WORDS
    )
    found = index.search("ereat vendor src3", top_k=None)
    return found.select(F.col("doc").alias("doc_id"), F.round("relevance", 6).alias("relevance"))
