"""The stages run one after the other over files."""

import json

from vulnspark import jobs, schemas
from vulnspark.sources import read_pages, read_xml

PAGE = """<h1 class="title">CVE-{i}</h1><p class="mb-0">Title: {i} run.py</p><p class="content">text {i}</p>
<time>2024-01-0{i}</time><div class="cve-y-scroll"><ul><li>CWE-79: XSS</li></ul></div>
<nav id="cve-vendor-product-platforms"><div class="level-item"><p class="cve-product-status-heading">Vendor</p><p>v{i}</p></div></nav>
<table class="cve-border-dark-blue"><tbody><tr><td data-label="Score">{i}.5</td><td data-label="Severity">HIGH</td>
<td data-label="Version">3.1</td></tr></tbody></table>"""


def answer(prompts):
    return ["answer"] * len(prompts)


def test_all_stages(spark, tmp_path):
    (tmp_path / "html").mkdir()
    for i in range(1, 4):
        (tmp_path / "html" / f"{i}.html").write_text(PAGE.format(i=i))
    read_pages(spark, str(tmp_path / "html"), "SQL Injection").orderBy("url").coalesce(1).write.parquet(str(tmp_path / "pages"))

    def run(*args):
        jobs.main([str(tmp_path / x) if x.startswith("@") else x for x in args])

    def at(name):
        return str(tmp_path / f"@{name}")

    run("collect", str(tmp_path / "pages"), "@raw")
    run("clean", "@raw", "@clean")
    run("nest", "@clean", "@nested")
    run("features", "@nested", "@features", "--parquet", "@table", "--report", "@report")
    run("eda", "@nested", "@eda")
    run("dashboard", "@features", "@panels", "--query", "text 2", "--top", "1")
    run("explain", "@features", "@explained", "--model", "test_jobs:answer", "--limit", "2")

    table = spark.read.parquet(at("table")).orderBy("cve_id").collect()
    assert [(r.cve_id, r.title, r.vendor_clean, r.cvss_score, r.year) for r in table] == [
        (f"CVE-{i}", f"{i}", f"v{i}", i + 0.5, 2024) for i in range(1, 4)]
    assert spark.read.json(at("report")).first().remaining == 3
    assert spark.read.parquet(at("eda") + "/severities").where("n = 3").first().severity == "HIGH"
    assert spark.read.parquet(at("panels") + "/feed").first().cve_id == "CVE-2"
    found = read_xml(spark, at("explained"), schemas.EXPLANATIONS).collect()
    assert sorted((r.cve_id, r.ai_explanation) for r in found) == [("CVE-1", "answer"), ("CVE-2", "answer")]


def test_the_last_record_of_an_id_is_the_last_in_the_files(spark, tmp_path):
    """The larger file, which Spark reads first, comes later by name."""
    base = {n: None for n in schemas.RAW_RECORD.fieldNames()}
    (tmp_path / "raw").mkdir()

    def record(cve, title):
        rating = {"version": "3.1", "score": "9.8", "severity": "HIGH", "vector": None}
        return json.dumps({**base, "cve_id": cve, "title": title, "description": "d", "vendor": "v", "cvss": [rating]})

    (tmp_path / "raw" / "a.json").write_text(record("CVE-1", "old") + "\n" + record("CVE-2", "one") + "\n")
    (tmp_path / "raw" / "b.json").write_text("\n".join([record("CVE-1", "new")] + [record(f"CVE-{i}", "x" * 400) for i in range(3, 60)]))
    for name, source, target in (("clean", "raw", "clean"), ("nest", "clean", "nested"), ("features", "nested", "features")):
        jobs.main([name, str(tmp_path / source), str(tmp_path / target)])
    jobs.main(["explain", str(tmp_path / "features"), str(tmp_path / "told"), "--model", "test_jobs:answer", "--limit", "3"])
    found = read_xml(spark, str(tmp_path / "features"), schemas.FEATURE_XML).collect()
    assert {r.cve_id: r.title for r in found}["CVE-1"] == "new" and len(found) == 59
    told = read_xml(spark, str(tmp_path / "told"), schemas.EXPLANATIONS).collect()
    assert sorted(r.cve_id for r in told) == ["CVE-1", "CVE-2", "CVE-3"]


def test_clean_json_with_the_word_unknown_for_weaknesses(spark, tmp_path):
    """Arrays of clean records written elsewhere may say ["unknown"] instead of a list."""
    base = {n: None for n in schemas.CLEAN_RECORD.fieldNames()}
    records = [
        {**base, "cve_id": "A", "title": "t", "cwe": ["unknown"], "cvss": [], "affected_versions": ["unknown"]},
        {**base, "cve_id": "B", "title": "u", "cwe": [{"id": "CWE-1", "name": "n"}],
         "cvss": [{"version": "3.1", "score": "9", "severity": "HIGH", "vector": None}]},
    ]
    (tmp_path / "clean.json").write_text(json.dumps(records, indent=4))
    jobs.main(["nest", str(tmp_path / "clean.json"), str(tmp_path / "xml"), "--array"])
    found = {r.cve_id: r for r in read_xml(spark, str(tmp_path / "xml"), schemas.RAW_XML).collect()}
    assert found["A"].title == "t" and found["B"].title == "u"
    assert not (found["A"].cwe_list and found["A"].cwe_list.cwe)
    assert found["B"].cwe_list.cwe[0].id == "CWE-1"
