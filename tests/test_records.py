"""Stages over small record tables."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from vulnspark import schemas
from vulnspark.operators.cleaning import clean_records
from vulnspark.operators.dedup import cap_per_group, first_n, keep_last
from vulnspark.operators.features import build_features, quality_report, to_feature_xml
from vulnspark.operators.reshape import nest_records
from vulnspark.operators.views import dashboard_view, eda_view
from vulnspark.plans import dashboard, eda_report, features_from_raw


def raw(seq, cve="CVE-1", title="A title", description="Some\n text", cvss=None, vendor=" acme ", **other):
    record = dict(
        cve_id=cve, title=title, description=description, published_date="2024-01-05",
        last_modified_date="2024-2-1", cwe=["CWE-79: XSS", "CWE-20: Input"],
        cvss=[("9.8", "critical", "3.1", "")] if cvss is None else cvss, vendor=vendor, product="box",
        affected_versions=["affected at 1"], attackType="cross-site  scripting",
    )
    record.update(other)
    return (seq, *[record[n] for n in schemas.RAW_RECORD.fieldNames()])


def raw_table(spark, rows):
    schema = schemas.T.StructType([schemas.T.StructField("_seq", schemas.T.LongType()), *schemas.RAW_RECORD.fields])
    return spark.createDataFrame(rows, schema)


def test_feature_row(spark):
    row = features_from_raw(raw_table(spark, [raw(1)])).first().asDict()
    assert {k: str(v) for k, v in row.items()} == {
        "cve_id": "CVE-1", "title": "A title", "vendor_clean": "acme",
        "attack_type_clean": "Cross-Site Scripting", "published_dt": "2024-01-05",
        "last_modified_dt": "2024-02-01", "year": "2024", "cvss_score": "9.8",
        "severity_level": "CRITICAL", "severity_numeric": "4", "cwe_count": "2",
        "cwe_ids": "CWE-79|CWE-20", "cwe_names_clean": "XSS|Input", "description_length": "9",
        "has_cvss": "1", "description": "Some text",
    }


def test_feature_schema(spark):
    found = features_from_raw(raw_table(spark, [raw(1)])).schema
    assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in schemas.FEATURES]


ROWS = [
    raw(1, "A"), raw(2, "B", vendor="second"), raw(3, "A", vendor="third"),
    raw(4, "C", title=None), raw(5, "D", vendor="n/a"), raw(6, "E", vendor="12"),
    raw(7, "F", cvss=[("5", "none", "3.1", None)]), raw(8, "F", cvss=[]),
    raw(9, "G", cvss=[("", "ODD", "", None)]), raw(10, "H", title="run.py"),
    raw(11, "I", description="UNKNOWN"),
]


def test_filters_and_duplicates(spark):
    found = {r.cve_id: r for r in features_from_raw(raw_table(spark, ROWS)).collect()}
    assert sorted(found) == ["A", "B", "G", "H"]
    assert found["A"].vendor_clean == "third"
    assert (found["G"].severity_level, found["G"].severity_numeric, found["G"].has_cvss) == ("ODD", None, 0)
    assert found["H"].title == ""


def test_quality_report(spark):
    nested = nest_records(clean_records(raw_table(spark, ROWS)))
    report = quality_report(nested, ["_seq"]).first()
    assert report.asDict() == {
        "loaded": 11, "unknown_dropped": 2, "vendor_dropped": 2, "duplicates_dropped": 2,
        "severity_dropped": 1, "remaining": 4,
    }
    assert report.remaining == build_features(nested, ["_seq"]).count()


def test_result_does_not_depend_on_partitions(spark):
    table = raw_table(spark, ROWS)
    one = features_from_raw(table.coalesce(1)).collect()
    many = features_from_raw(table.repartition(7)).collect()
    assert sorted(one) == sorted(many)


def test_features_twice_is_the_same(spark):
    table = raw_table(spark, ROWS)
    once = keep_last(table, ["cve_id"], ["_seq"])
    assert once.select("cve_id").distinct().count() == once.count()
    assert sorted(r._seq for r in keep_last(once, ["cve_id"], ["_seq"]).collect()) == sorted(
        r._seq for r in once.collect())


def test_legacy_cleaning(spark):
    row = clean_records(raw_table(spark, [raw(1, vendor="PromtEngineer")]), legacy=True).first()
    assert (row.vendor, row.product, row.affected_versions) == ("PromtEngineer", "2024-2-1", ["b", "o", "x"])
    row = clean_records(raw_table(spark, [raw(1, vendor="PromtEngineer", product="")]), legacy=True).first()
    assert row.affected_versions == ["unknown"]
    row = clean_records(raw_table(spark, [raw(1, vendor=" PromtEngineer ", product=None)])).first()
    assert (row.vendor, row.product, row.affected_versions) == ("PromptEngineer", "unknown", ["1"])


def test_nesting(spark):
    row = nest_records(clean_records(raw_table(spark, [raw(1, vendor=" N/A ")]))).first()
    assert row.vendor == "unknown"
    assert row.dates == Row(published="2024-01-05", last_modified="2024-2-1")
    assert [c.asDict() for c in row.cvss_list.cvss] == [{"score": "9.8", "severity": "critical", "version": "3.1"}]
    assert "affected_versions" not in row.asDict()


def test_dashboard_panels(spark):
    features = to_feature_xml(features_from_raw(raw_table(spark, ROWS)))
    panels = dashboard(features, severities=[], query="title acme", stop_words=["a"])
    assert panels["key_figures"].first().asDict() == {
        "total": 4, "critical": 3, "high": 0, "medium": 0, "mean_score": "9.8"}
    assert [tuple(r) for r in panels["severities"].collect()] == [("Critical", 3), ("Odd", 1)]
    assert [tuple(r) for r in panels["attack_types"].collect()] == [("Cross-Site Scripting", 4, 1.0)]
    assert [tuple(r) for r in panels["top_vendors"].collect()] == [("acme", 2), ("second", 1), ("third", 1)]
    assert [tuple(r) for r in panels["top_cwe"].collect()] == [("CWE-79, CWE-20", 4)]
    assert panels["score_bands"].first().asDict() == {"at_least_9": 3, "at_least_7": 3}
    assert [tuple(r) for r in panels["score_histogram"].collect()] == [(9.0, 1.0, 3)]
    feed = panels["feed"].collect()
    assert feed[0].cve_id == "G" and all(0 < r.relevance <= 1 for r in feed)
    assert dashboard(features, attack_types=["XSS"])["rows"].count() == 0
    assert dashboard(features, severities=["Critical"], minimum=0.5)["rows"].count() == 3


def test_dashboard_markers(spark):
    schema = schemas.FEATURE_XML
    blank = (None, "unknown", "", "UNKNOWN", None, None, ("x", None, None, None), ("0", "", ""), (None, " "))
    named = ("C", "t", "v", "a", ("", "d"), "", ("7.5", "HIGH", "", ""), ("2", "CWE-1|CWE-2", ""), ("1", "x"))
    na = ("N/A", "t", "v", "a", ("", ""), "", None, None, None)
    rows = dashboard_view(spark.createDataFrame([blank, named, na], schema)).collect()
    assert [tuple(r) for r in rows] == [
        ("C", "t", "x", 7.5, "High", "a", "CWE-1, CWE-2", "v", "N/A", "d")]
    blank = ("Z", *blank[1:])
    row = dashboard_view(spark.createDataFrame([blank], schema)).first()
    assert tuple(row) == ("Z", "N/A", "N/A", None, "Unknown", "UNKNOWN", "N/A", "N/A", "N/A", "N/A")


def test_eda_report(spark):
    rows = [
        ("1", "v", "SQL Injection", [("9", "HIGH", "3.1"), ("9.0", "LOW", "2")], "2024-01-01"),
        ("2", "v", "sql injection", [("x", "HIGH", "3.1")], "2024-01-01"),
        ("3", None, None, [("4", "low", "3.1")], "soon"),
        ("4", "w", "other", None, None),
    ]
    nested = spark.createDataFrame(rows, "cve_id string, vendor string, attack_type string, "
                                   "c array<struct<score:string,severity:string,version:string>>, p string")
    nested = nested.select("cve_id", "vendor", "attack_type", F.struct(F.col("c").alias("cvss")).alias("cvss_list"),
                           F.struct(F.col("p").alias("published")).alias("dates"))
    report = {k: [tuple(r) for r in v.collect()] for k, v in eda_report(eda_view(nested)).items()}
    assert report["total"] == [(4,)]
    assert dict(report["null_counts"]) == {
        "cve_id": 0, "vendor": 1, "attack_type": 1, "cvss_score": 2, "severity": 2, "published": 1}
    assert report["mean_by_attack"] == [("SQL Injection", 9.0), (None, 4.0)]
    assert report["severities"] == [("LOW", 0), ("MEDIUM", 0), ("HIGH", 1), ("CRITICAL", 0)]
    assert report["undated"] == [(True,)]
    assert [n for _, n in report["timeline"]] == [2]
    assert report["top_vendors"] == [("v", 2), ("w", 1)]
    cross = {(a, s): n for a, s, n in report["severity_by_attack"]}
    assert len(cross) == 16 and cross[("sql injection", "HIGH")] == 1 and sum(cross.values()) == 1


def test_cap_and_first_n(spark):
    rows = spark.createDataFrame([(g, i) for g in "ab" for i in range(50)], "g string, i int").repartition(6)
    capped = cap_per_group(rows, ["g"], ["i"], 7, fan_in=3).collect()
    assert sorted((r.g, r.i) for r in capped) == [(g, i) for g in "ab" for i in range(7)]
    assert [r.i for r in first_n(rows.where("g = 'a'"), ["i"], 3).collect()] == [0, 1, 2]
    assert first_n(rows, ["i"], 0).count() == 100
