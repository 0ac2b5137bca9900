"""Files: XML in odd states, JSON, robots texts, document order."""

import os
import re

import pytest

from vulnspark import schemas
from vulnspark.sources import DOC_ORDER, disallowed_paths, read_records, read_xml, write_records, write_xml

SMALL = schemas.T.StructType(
    [schemas.T.StructField("cve_id", schemas.T.StringType()), schemas.T.StructField("title", schemas.T.StringType())]
)


def record(cve, title):
    return f"<vulnerability>\n  <cve_id>{cve}</cve_id>\n  <title>{title}</title>\n</vulnerability>\n"


def write(path, body, encoding="utf-8", head='<?xml version="1.0" encoding="utf-8"?>\n', bom=b""):
    text = f"{head}<vulnerabilities>\n{body}</vulnerabilities>"
    path.write_bytes(bom + text.encode(encoding))
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_plain_bom_and_missing_declaration(spark, tmp_path):
    body = record("A", "café &amp; co") + record("B", "")
    want = [("A", "café & co"), ("B", "")]
    assert rows(read_xml(spark, write(tmp_path / "a.xml", body), SMALL)) == want
    assert rows(read_xml(spark, write(tmp_path / "b.xml", body, bom=b"\xef\xbb\xbf"), SMALL)) == want
    assert rows(read_xml(spark, write(tmp_path / "c.xml", body, head="  "), SMALL)) == want


def test_latin_1_fallback_is_per_file(spark, tmp_path):
    write(tmp_path / "latin file.xml", record("A", "café") + record("B", "plain"), "latin-1")
    write(tmp_path / "utf.xml", record("C", "zü"))
    found = rows(read_xml(spark, str(tmp_path), SMALL, encoding="auto"))
    assert found == [("A", "café"), ("B", "plain"), ("C", "zü")]
    only = write(tmp_path / "latin2.xml", record("D", "é"), "latin-1")
    assert rows(read_xml(spark, only, SMALL, encoding="latin-1")) == [("D", "é")]


BROKEN = record("A", "x & y") + record("B", "good") + "<vulnerability><cve_id>C</cve_id><title>cut"


def test_malformed_records(spark, tmp_path):
    path = write(tmp_path / "a.xml", BROKEN)
    assert rows(read_xml(spark, path, SMALL, on_error="drop")) == [("B", "good")]
    kept = read_xml(spark, path, SMALL, on_error="keep").collect()
    assert len(kept) == 3 and sum(r["_corrupt_record"] is None for r in kept) == 1
    assert rows(read_xml(spark, path, SMALL, on_error="empty")) == []
    with pytest.raises(Exception):
        read_xml(spark, path, SMALL).collect()
    good = write(tmp_path / "b.xml", record("B", "good"))
    assert rows(read_xml(spark, good, SMALL, on_error="empty")) == [("B", "good")]
    with pytest.raises(ValueError):
        read_xml(spark, path, SMALL, on_error="ignore")


def test_repeated_children_and_absent_elements(spark, tmp_path):
    one = "<vulnerability><cve_id>A</cve_id><cwe_list><cwe><id>CWE-1</id></cwe></cwe_list></vulnerability>"
    none = "<vulnerability><cve_id>B</cve_id><title/><cwe_list></cwe_list></vulnerability>"
    found = read_xml(spark, write(tmp_path / "a.xml", one + none), schemas.RAW_XML).orderBy("cve_id").collect()
    assert [c.id for c in found[0].cwe_list.cwe] == ["CWE-1"]
    assert found[0].title is None and found[1].title == ""
    assert found[1].cwe_list is None or not found[1].cwe_list.cwe


def test_one_file_is_read_by_many_tasks_in_document_order(spark, tmp_path):
    names = [f"{i:05d}" for i in range(3000)]
    path = write(tmp_path / "big.xml", "".join(record(n, "t" * 50) for n in names))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(os.path.getsize(path) // 6))
        df = read_xml(spark, path, SMALL, order=True)
        assert df.rdd.getNumPartitions() >= 6
        assert [r.cve_id for r in df.orderBy(*DOC_ORDER).collect()] == names
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_written_xml_comes_back(spark, tmp_path):
    path = str(tmp_path / "out")
    data = [("A", "a < b & \"c\""), ("B", ""), ("C", "é 中")]
    write_xml(spark.createDataFrame(data, SMALL), path)
    assert rows(read_xml(spark, path, SMALL)) == data
    text = "".join((tmp_path / "out" / f).read_text() for f in os.listdir(path) if f.endswith(".xml"))
    assert text.startswith("<?xml") and "<vulnerabilities>" in text
    assert rows(spark.read.format("xml").schema(SMALL).option("rowTag", "vulnerability").load(path)) == data


def test_json_array_and_lines(spark, tmp_path):
    one = '[{"cve_id": "A", "cwe": ["x"], "cvss": [{"score": "9.8", "severity": null}]},\n {"cve_id": "é", "cwe": []}]'
    (tmp_path / "a.json").write_text(one, encoding="utf-8")
    found = read_records(spark, str(tmp_path / "a.json"), schemas.RAW_RECORD, array=True)
    assert sorted(r.cve_id for r in found.collect()) == ["A", "é"]
    assert found.where("cve_id = 'A'").first().cvss[0].score == "9.8"
    write_records(found, str(tmp_path / "lines"))
    back = read_records(spark, str(tmp_path / "lines"), schemas.RAW_RECORD)
    assert sorted(map(str, back.collect())) == sorted(map(str, found.collect()))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "lines").glob("*.json"))
    assert "é" in text and '"vendor":null' in text


def test_a_look_at_arrays_reads_one_file(spark, tmp_path):
    """Whether records carry numbers is told by one file, or by all if that one has no record."""
    from vulnspark.sources import in_sequence

    folder = tmp_path / "arrays"
    folder.mkdir()
    for name, rows in (("a", "[]"), ("b", '[{"cve_id": "x"}, {"cve_id": "y"}]'), ("c", '[{"cve_id": "z"}]')):
        (folder / f"{name}.json").write_text(rows)
    schema = schemas.with_seq(schemas.RAW_RECORD)
    rows = read_records(spark, str(folder), schema, array=True, order=True)
    some = read_records(spark, str(folder), schema, array=True, one_file=True)
    assert rows.count() == 3 and some.count() < 3
    for peek in (some, rows.where("false")):
        found = in_sequence(rows, schemas.SEQ, peek=peek).orderBy(schemas.SEQ).collect()
        assert [r["cve_id"] for r in found] == ["x", "y", "z"]


def test_balance_of_pieces(spark):
    """What opens and closes in a piece of JSON, whether it begins in a string or not."""
    from vulnspark.sources.records import _sums

    pieces = ["{[", 'a "{[" [', '"]" : [ "{', "no }]", '"', "", 'x" [ "] "{', r'\" "\\" [ \[ "{"', '[" "[" "']
    rows = spark.createDataFrame([("f", 0, i, p) for i, p in enumerate(pieces)], "_json_path string, _json_block long, _json_row long, value string")
    for p, r in zip(pieces, _sums(rows).orderBy("_json_row").collect()):
        parts = re.sub(r"\\.", "", p).split('"')
        end = [sum(c in "[{" for c in t) - sum(c in "]}" for c in t) for t in ("".join(parts[::2]), "".join(parts[1::2]))]
        odd = len(parts) % 2 == 0
        assert (r["quotes"], r["outside"], r["inside"]) == (len(parts) - 1, end[0] - (not odd), end[1] - odd)


def test_robots(spark):
    lines = ["User-agent: *", "Disallow: /a ", "Disallow:", " Disallow: /no", "Allow: /", "Disallow: /x:y"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(disallowed_paths(df)) == [("",), ("/a",), ("/x:y",)]


def nested(spark, tmp_path, body, **options):
    """The records as read in one split and in many."""
    path = write(tmp_path / f"x{len(list(tmp_path.iterdir()))}.xml", body)
    out = []
    for size in ("128m", "64b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            out.append([tuple(r) for r in read_xml(spark, path, SMALL, order=True, **options).orderBy(*DOC_ORDER).drop(*DOC_ORDER).collect()])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert out[0] == out[1]
    return out[0]


def test_no_record_is_lost(spark, tmp_path):
    r1, r2, r3 = (record(c, "t") for c in ("C1", "C2", "C3"))
    three = [("C1", "t"), ("C2", "t"), ("C3", "t")]
    assert nested(spark, tmp_path, r1 + "<vulnerability/>" + r2 + "<vulnerability a='1' />" + r3) == [
        ("C1", "t"), (None, None), ("C2", "t"), (None, None), ("C3", "t")
    ]
    assert nested(spark, tmp_path, r1.replace("</vulnerability>", "</vulnerability  >") + r2 + r3) == three
    assert nested(spark, tmp_path, r1 + "<!--" + r2 + "-->" + r3) == [three[0], three[2]]
    assert nested(spark, tmp_path, r1 + "<!-- " + r2 + r2 + r2 + " -->" + r3) == [three[0], three[2]]
    assert nested(spark, tmp_path, r1 + "<!-- a note -->" + r2 + r3) == three
    odd = record("C2", "<![CDATA[a </vulnerability> b]]>")
    assert nested(spark, tmp_path, r1 + odd + r3) == [three[0], ("C2", "a </vulnerability> b"), three[2]]


def test_a_cut_file_is_malformed(spark, tmp_path):
    path = tmp_path / "cut.xml"
    path.write_text("<vulnerabilities>" + record("A", "x") + "<vulnerability><cve_id>B</cve_id><title>y</title>")
    assert rows(read_xml(spark, str(path), SMALL, on_error="drop")) == [("A", "x")]
    assert rows(read_xml(spark, str(path), SMALL, on_error="empty")) == []
    with pytest.raises(Exception):
        read_xml(spark, str(path), SMALL).collect()


def test_a_bad_file_empties_only_itself(spark, tmp_path):
    write(tmp_path / "good.xml", record("A", "x"))
    write(tmp_path / "bad.xml", record("B", "x") + record("C", "x & y"))
    assert rows(read_xml(spark, str(tmp_path), SMALL, on_error="empty")) == [("A", "x")]


def test_part_files_sort_by_number(spark, tmp_path):
    for n in (99999, 100000):
        write(tmp_path / f"part-{n}.xml", record(str(n), "x"))
    found = read_xml(spark, str(tmp_path), SMALL, order=True).orderBy(*DOC_ORDER).collect()
    assert [r["cve_id"] for r in found] == ["99999", "100000"]
