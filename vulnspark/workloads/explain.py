"""Batch explanations with a model stand-in."""

from pyspark.sql import functions as F

from vulnspark.operators import enrich
from vulnspark.operators.dedup import first_n
from vulnspark.operators.features import build_features, to_feature_xml
from vulnspark.operators.cleaning import clean_records
from vulnspark.operators.reshape import nest_records
from vulnspark.operators.views import explanation_input
from vulnspark.sources.scan import spread
from vulnspark.plans.consumers import explanations
from vulnspark.schemas import FEATURE_XML, with_seq
from vulnspark.session import scratch_path
from vulnspark.sources import read_xml, write_xml
from vulnspark.workloads import records
from vulnspark.workloads.base import WORKLOADS, slots, table, workload
from vulnspark.workloads.derived import raw_records

# How many rows the queries on the first rows ask for.
EXPLAIN_LIMIT = 200

_PROMPT_SQL = (
    "'" + enrich.INSTRUCTIONS + "' || chr(10) || 'CVE ID: ' || doc_id || chr(10) || 'Attack Type: ' || lang "
    "|| chr(10) || 'Description: ' || text || chr(10) || chr(10) || 'Explanation:'"
)


def length_model(prompts: list[str]) -> list[str]:
    """Stand-in for a model: answers with the prompt's length, refuses some prompts."""
    if any("\nAttack Type: fr\n" in p for p in prompts):
        raise ValueError("refused")
    return [f" {len(p)} characters " for p in prompts]


@workload("prompt_projection", f"SELECT doc_id, {_PROMPT_SQL} AS prompt FROM documents")
def prompt_projection(spark, sf_dir):
    text = enrich.prompt(F.col("doc_id").cast("string"), F.col("lang"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("prompt"))


@workload(
    "limit_first_n",
    f"SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT {EXPLAIN_LIMIT}",
)
def limit_first_n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return first_n(docs, ["doc_id"], EXPLAIN_LIMIT)


@workload("preview80", "SELECT doc_id, text[:80] AS preview FROM documents")
def preview80(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", enrich.preview_text(F.col("text")).alias("preview")
    )


@workload(
    "batch_explain_stub",
    f"""SELECT doc_id, CASE WHEN lang = 'fr' THEN '{enrich.FAILED}'
          ELSE length({_PROMPT_SQL}) || ' characters' END AS ai_explanation FROM documents""",
)
def batch_explain_stub(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), slots(spark))
    prompt = enrich.prompt(F.col("doc_id").cast("string"), F.col("lang"), F.col("text"))
    return enrich.explain(docs, prompt, length_model).select("doc_id", "ai_explanation")


@workload(
    "explanation_rows",
    f"""SELECT cve_id, title, vendor_clean AS vendor, attack_type_clean AS attack_type, severity_level AS severity,
          coalesce(CAST(cvss_score AS VARCHAR), '') AS score, description,
          (length(cve_id) + length(attack_type_clean) + length(description) + length({
        "'" + enrich.INSTRUCTIONS + "' || chr(10) || 'CVE ID: ' || chr(10) || 'Attack Type: ' || chr(10) || 'Description: ' || chr(10) || chr(10) || 'Explanation:'"
    })) || ' characters' AS ai_explanation
        FROM ({records.FEATURES_SQL}) WHERE description <> ''""",
)
def explanation_rows(spark, sf_dir):
    """Every row of a feature XML file with a description, explained."""
    path = scratch_path(spark, "explained-features")
    features = build_features(nest_records(clean_records(raw_records(spark, sf_dir))), ["_seq"], keep=["_seq"])
    write_xml(to_feature_xml(features), path)
    return explanations(read_xml(spark, path, with_seq(FEATURE_XML)), length_model, ["_seq"])


@workload("all_explanation_rows", WORKLOADS["explanation_rows"].sql)
def all_explanation_rows(spark, sf_dir):
    """Every row of the feature table with a description, explained without a file in between."""
    features = build_features(nest_records(clean_records(raw_records(spark, sf_dir))), ["_seq"])
    return explanations(to_feature_xml(features), length_model, ["cve_id"])


@workload(
    "explanation_input",
    """SELECT doc_id, coalesce(source, 'Unknown') AS vendor, title, severity, trim(text) AS description FROM (
         SELECT d.doc_id, source, CASE WHEN quality IS NULL THEN 'Unknown' WHEN quality = 1 THEN '' ELSE lang END AS title,
           CASE WHEN toxic = 1 THEN 'HIGH' ELSE 'Unknown' END AS severity,
           CASE WHEN toxic = 0 THEN '  ' ELSE text END AS text
         FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE trim(text) <> ''""",
)
def explanation_inputs(spark, sf_dir):
    joined = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang", "source", "text")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
    )
    title = F.when(F.col("quality") == 1, "").when(F.col("quality").isNotNull(), F.col("lang"))
    severity = F.when(F.col("toxic") == 1, "HIGH")
    description = F.when(F.col("toxic") == 0, "  ").otherwise(F.col("text"))
    none = F.lit(None).cast("string")
    xml = joined.select(
        F.col("doc_id").alias("_doc"), none.alias("cve_id"), title.alias("title"), F.col("source").alias("vendor"),
        none.alias("attack_type"),
        F.struct(severity.alias("severity_level"), none.alias("score")).alias("cvss_features"),
        F.struct(description.alias("text")).alias("description_features"),
    )
    return explanation_input(xml).select(
        F.col("_doc").alias("doc_id"), "vendor", "title", "severity", "description"
    )
