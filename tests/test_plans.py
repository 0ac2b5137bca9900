"""Shapes of physical plans that matter at scale."""

import os
import re

import pytest
from test_records import ROWS, raw_table

from vulnspark import schemas
from vulnspark.operators import search
from vulnspark.operators.dedup import keep_last
from vulnspark.operators.features import quality_report
from vulnspark.operators.cleaning import clean_records
from vulnspark.operators.reshape import nest_records
from vulnspark.plans import features_from_raw
from vulnspark.sources import read_xml

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_one_exchange_without_python(spark):
    text = plan(features_from_raw(raw_table(spark, ROWS)))
    assert text.count("Exchange hashpartitioning(cve_id") == 1 and text.count("Exchange") == 1
    assert text.count("WindowGroupLimit") == 2
    assert "EvalPython" not in text and "MapIn" not in text


def test_costly_columns_are_computed_once(spark):
    text = plan(features_from_raw(raw_table(spark, ROWS)))
    assert len(re.findall(r"RLIKE", text)) == 1


def test_xml_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><vulnerability><cve_id>A</cve_id></vulnerability></r>")
    nested = read_xml(spark, str(tmp_path), schemas.RAW_XML, order=True)
    assert plan(nested.where("cve_id = 'A'")).count("from_xml(") == 1
    nested = read_xml(spark, str(tmp_path), schemas.RAW_XML)
    assert plan(nested.where("cve_id = 'A'")).count("from_xml(") == 1


def test_quality_report_shuffles_counters_only(spark):
    text = plan(quality_report(nest_records(clean_records(raw_table(spark, ROWS))), ["_seq"]))
    assert "Window" not in text and "partial_" in text


def test_building_a_plan_runs_no_job(spark):
    from vulnspark.operators.features import to_feature_xml
    from vulnspark.plans import collect_records, dashboard, explanations

    table = raw_table(spark, ROWS)
    pages = spark.createDataFrame([(1, "x", "<h1>")], "seq int, attack string, html string")
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        features = to_feature_xml(features_from_raw(table))
        explanations(features, lambda prompts: prompts, ["cve_id"])
        dashboard(features, query="some words")
        collect_records(pages)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@needs_data
def test_scans_are_pruned(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'click'").select("user_id", "event_id", "ts")
    text = plan(keep_last(rows, ["user_id"], ["ts", "event_id"]).drop("ts"))
    assert "EqualTo(event_type,click)" in text
    assert "props" not in text and "value" not in re.search(r"ReadSchema: .*", text).group()
    assert text.count("Exchange") == 1 and text.count("WindowGroupLimit") == 2


@needs_data
def test_search_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = search.rank(docs, "the tion", "doc_id", ["text"], 25, ["of"])
    text = plan(found)
    assert "TakeOrderedAndProject" in text
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "EvalPython" not in text and "MapIn" not in text


@needs_data
def test_stored_index_pushes_the_terms(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = search.TfidfIndex.build(docs, "doc_id", search.corpus_text(["text"]), str(tmp_path / "i"), ["of"])
    text = plan(index.search("and the", 5))
    assert "In(term" in text and "TakeOrderedAndProject" in text
