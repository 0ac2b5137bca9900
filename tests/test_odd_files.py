"""XML and JSON arrays cut into splits at every place, against parsers that read whole files."""

import json
import random
import xml.etree.ElementTree as ET
from contextlib import contextmanager

import pytest

from vulnspark import schemas
from vulnspark.sources import DOC_ORDER, read_records, read_xml, write_records
from vulnspark.sources import xml as xml_source

SMALL = schemas.T.StructType(
    [schemas.T.StructField("cve_id", schemas.T.StringType()), schemas.T.StructField("title", schemas.T.StringType())]
)
HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<vulnerabilities>\n'
TAIL = "</vulnerabilities>"


@contextmanager
def splits_of(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def record(cve, title, tag="vulnerability"):
    return f"<{tag}><cve_id>{cve}</cve_id><title>{title}</title></{tag}>\n"


def parsed(text):
    return [(v.findtext("cve_id"), v.findtext("title") or "") for v in ET.fromstring(text).iter("vulnerability")]


def found(spark, path, **options):
    df = read_xml(spark, str(path), SMALL, order=True, **options)
    return [(r["cve_id"], r["title"]) for r in df.orderBy(*DOC_ORDER).collect()]


FILES = {
    "comment mark in CDATA": record("C1", "<![CDATA[a <!-- b]]>") + record("C2", "x") + record("C3", "y"),
    "end of comment in text": record("C1", "a --&gt; b").replace("&gt;", ">") + "<!-- " + record("C2", "x") + " -->" + record("C3", "y"),
    "comment over records": record("C1", "x") + "<!--" + record("C2", "x") + record("C3", "y") + "-->" + record("C4", "z"),
    "tag in CDATA": record("C1", "<![CDATA[see <vulnerability> and </vulnerability> too]]>") + record("C2", "x"),
    "comment in a record": "<vulnerability><cve_id>C1</cve_id><!-- <vulnerability> </vulnerability> --><title>t</title></vulnerability>" + record("C2", "x"),
    "instruction": "<?note <vulnerability> ?>" + record("C1", "x") + "<?a?>" + record("C2", "<![CDATA[?>-->]]>"),
    "longer names": "<vulnerability_note>n</vulnerability_note><vulnerability><cve_id>C1</cve_id><title>t</title><vulnerability-x>1</vulnerability-x></vulnerability >" + record("C2", "x"),
    "attributes and self-closing": "<vulnerability a='1>2' b=\"/>\"><cve_id>C1</cve_id><title>t</title></vulnerability><vulnerability />" + record("C2", "x"),
    "closing tag in a comment": record("C1", "x") + "<!-- </vulnerability> -->" + record("C2", "<!-- a -->b<![CDATA[]]]]><![CDATA[>]]>"),
}


@pytest.mark.parametrize("size, mode", [(41, "fail"), (97, "drop"), (230, "empty"), (1 << 20, "keep")])
def test_every_construct_over_every_split(spark, tmp_path, size, mode):
    want = []
    for i, body in enumerate(FILES.values()):
        (tmp_path / f"{i}.xml").write_text(HEAD + body.replace("<cve_id>C", f"<cve_id>{i}-C") + TAIL)
        want += [(c, t) for c, t in parsed((tmp_path / f"{i}.xml").read_text()) if c is not None]
    with splits_of(spark, size):
        got = found(spark, tmp_path, on_error=mode)
        assert [x for x in got if x[0] is not None] == want


def test_files_made_at_random(spark, tmp_path):
    rng = random.Random(7)
    inner = ["a", "--", "]]", "&lt;", "é", " <b>x</b> ", "<!-- <vulnerability> -->", "<![CDATA[<!-- <vulnerability>]]>", "<![CDATA[</vulnerability>]]>", "<?p <vulnerability ?>"]
    between = ["", "\n", "<!-- x " + record("no", "no") + " -->", "<?q " + record("no", "no") + "?>", "<!---->", "<other>1</other>"]
    want = {}
    for f in range(8):
        body = "".join(
            record(f"{f}-{i}", "".join(rng.choice(inner) for _ in range(rng.randint(0, 4)))) + rng.choice(between) for i in range(rng.randint(1, 25))
        )
        (tmp_path / f"{f:02d}.xml").write_text(HEAD + body + TAIL)
        want[f] = [c for c, _ in parsed(HEAD + body + TAIL)]
    for size in (150,):
        with splits_of(spark, size):
            assert [c for c, _ in found(spark, tmp_path)] == [c for f in sorted(want) for c in want[f]]


def test_many_runs(spark, tmp_path, monkeypatch):
    """Constructs that go on over several runs of pieces and several splits."""
    monkeypatch.setattr(xml_source, "_RUN_BITS", 3)
    body = "".join(record(str(i), "<![CDATA[<!--]]>") + ("<!-- " + record("no", "x") * 30 + "-->" if i % 40 == 0 else "") for i in range(400))
    path = tmp_path / "a.xml"
    path.write_text(HEAD + body + TAIL)
    with splits_of(spark, 4000):
        assert [c for c, _ in found(spark, path)] == [str(i) for i in range(400)]


def test_reading_xml_plans_without_a_job(spark, tmp_path):
    path = tmp_path / "a.xml"
    path.write_text(HEAD + FILES["comment over records"] + TAIL)
    spark.sparkContext.setJobGroup("reading", "reading")
    try:
        read_xml(spark, str(path), SMALL)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("reading")
    finally:
        spark.sparkContext.setJobGroup("", "")


# -- JSON arrays ------------------------------------------------------------------


def raw(i, rng):
    odd = ["", "plain", 'quote " and \\ slash', "brace } { ] [", "new\nline", "é 中", '\\"}', '"},{"', "\\\\"]
    return {
        "cve_id": f"{i:05d}", "title": rng.choice(odd), "description": "".join(rng.choice(odd) for _ in range(3)),
        "cwe": [rng.choice(odd) for _ in range(rng.randint(0, 3))],
        "cvss": [{"score": rng.choice(odd), "severity": None} for _ in range(rng.randint(0, 3))],
    }


def shown(df):
    return [(r["cve_id"], r["title"], r["description"], list(r["cwe"]), [c["score"] for c in r["cvss"]]) for r in df.orderBy(*DOC_ORDER).collect()]


@pytest.mark.parametrize("size", [200, 5000])
@pytest.mark.parametrize("layout", [{"indent": 2}, {"separators": (",", ":")}, {"indent": None, "ensure_ascii": False}])
def test_arrays_cut_anywhere(spark, tmp_path, size, layout):
    rng = random.Random(3)
    records = [[raw(100 * f + i, rng) for i in range(n)] for f, n in enumerate([40, 1, 0, 15])]
    for f, some in enumerate(records):
        (tmp_path / f"{f}.json").write_text(json.dumps(some, **layout), encoding="utf-8")
    want = [(r["cve_id"], r["title"], r["description"], r["cwe"], [c["score"] for c in r["cvss"]]) for some in records for r in some]
    with splits_of(spark, size):
        df = read_records(spark, str(tmp_path), schemas.RAW_RECORD, array=True, order=True)
        assert shown(df) == want


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    records = [raw(i, rng) for i in range(2000)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(records))
    with splits_of(spark, 20_000):
        scan = spark.read.option("lineSep", "}").text(str(path))
        assert scan.rdd.getNumPartitions() > 5
        assert read_records(spark, str(path), schemas.RAW_RECORD, array=True).count() == 2000


def test_odd_arrays(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('﻿[1, "}", null, {"cve_id": "A"}, [2], {"cve_id": "B", "cvss": [{}]}]\n[{"cve_id": "C"}]  {"cve_id": "cut', encoding="utf-8")
    found = read_records(spark, str(path), schemas.RAW_RECORD, array=True)
    assert sorted(r["cve_id"] for r in found.collect()) == ["A", "B", "C"]
    (tmp_path / "b.json").write_text("")
    assert read_records(spark, str(tmp_path / "b.json"), schemas.RAW_RECORD, array=True).count() == 0


def test_written_arrays_are_json(spark, tmp_path):
    rng = random.Random(5)
    df = spark.createDataFrame([(r["cve_id"], r["title"]) for r in (raw(i, rng) for i in range(60))], SMALL)
    write_records(df, str(tmp_path / "out"), array=True)
    files = list((tmp_path / "out").rglob("*.txt"))
    assert sorted((r["cve_id"], r["title"]) for f in files for r in json.loads(f.read_text())) == sorted(map(tuple, df.collect()))
    back = read_records(spark, str(tmp_path / "out"), schemas.RAW_RECORD, array=True)
    assert sorted((r["cve_id"], r["title"]) for r in back.collect()) == sorted(map(tuple, df.collect()))
