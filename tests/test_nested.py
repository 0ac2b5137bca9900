"""List rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from vulnspark.functions import nested

CVSS = "array<struct<score:string,severity:string,version:string,vector:string>>"
LISTS = "sc array<double>, se array<string>, ve array<string>"


def item(version, score, severity, vector=None):
    return (score, severity, version, vector)


def test_clean_cvss(value):
    given = [item("3.1", "9.8", "CRITICAL"), item("3.1", "9.8", "-"), item("", None, ""), item(None, None, "HIGH", "")]
    found = value(nested.clean_cvss(F.col("c")), f"c {CVSS}", c=given)
    assert [(r.version, r.score, r.severity) for r in found] == [
        ("3.1", "9.8", "CRITICAL"), ("unknown", None, "unknown")]
    assert value(nested.clean_cvss(F.col("c")), f"c {CVSS}", c=None) == []
    only = value(nested.clean_cvss(F.col("c")), f"c {CVSS}", c=[item("2.0", "1", "—", "")])
    assert (only[0].severity, only[0].vector) == ("unknown", "unknown")


def test_parse_cwe(value):
    given = ["CWE-79: XSS", "CWE-20:x", "CWE-89 SQL", " CWE-1: y", "CWE-5:  "]
    found = value(nested.parse_cwe(F.col("c")), "c array<string>", c=given)
    assert [(r.id, r.name) for r in found] == [("CWE-79", "XSS"), ("CWE-20", "x"), ("CWE-5", " ")]
    assert value(nested.parse_cwe(F.col("c")), "c array<string>", c=None) == []


def test_clean_versions(value):
    f = nested.clean_versions(F.col("c"))
    assert value(f, "c array<string>", c=["affected at 1.2", "2"]) == ["1.2", "2"]
    assert value(f, "c array<string>", c=[]) == ["unknown"]
    assert value(f, "c array<string>", c=None) == ["unknown"]


def test_cwe_names(value):
    f = nested.clean_cwe_names(nested.split_pipes(F.col("c")))
    assert value(f, "c array<string>", c=["CWE-79: XSS", "CWE-89 SQL", "plain", "CWE-1:", "a|CWE-2: b"]) == [
        "XSS", "SQL", "plain", "a", "b"]
    assert value(f, "c array<string>", c=[]) == []


@pytest.mark.parametrize(
    "scores, severities, versions, score, severity",
    [
        ([9.8, 7.5], ["CRITICAL", "HIGH"], ["2.0", "3.1"], 7.5, "HIGH"),
        ([5.0], ["HIGH", "CRITICAL"], ["3.1", "2.0"], 5.0, "CRITICAL"),
        ([], ["ODD"], ["3.1"], None, "ODD"),
        ([4.0], [], ["3.1"], 4.0, None),
        ([6.0, 6.1], ["MEDIUM", "LOW"], ["4.0", "3.0"], 6.1, "LOW"),
        ([1.0, 2.0], ["LOW"], ["3.1", "3.1"], 1.0, "LOW"),
        ([3.0, 2.0], ["LOW", "HIGH"], ["9", "8"], 3.0, "HIGH"),
        ([], [], [], None, None),
    ],
)
def test_best(value, scores, severities, versions, score, severity):
    row = dict(sc=scores, se=severities, ve=versions)
    sc, se, ve = F.col("sc"), F.col("se"), F.col("ve")
    assert value(nested.best_score(sc, ve), LISTS, **row) == score
    assert value(nested.best_severity(se, ve, sc), LISTS, **row) == severity


def test_lists_are_independent(value):
    given = [("", "unknown", "2.0", None), ("7.5", " high ", "3.1", None), ("x", "ODD", " ", None)]
    c = F.col("c")
    assert value(nested.scores(c), f"c {CVSS}", c=given) == [7.5]
    assert value(nested.severities(c), f"c {CVSS}", c=given) == ["HIGH", "ODD"]
    assert value(nested.non_blank(c, "version"), f"c {CVSS}", c=given) == ["2.0", "3.1"]
    assert value(nested.scores(c), f"c {CVSS}", c=None) == []


def test_top_score(value):
    f = nested.top_score(F.col("c"))
    best = value(f, f"c {CVSS}", c=[("9.8", "A", "", ""), ("9.8", "B", "", ""), ("1", "C", "", "")])
    assert (best.score, best.severity) == (9.8, "A")
    assert value(f, f"c {CVSS}", c=[("x", "A", "", "")]) is None
    assert value(f, f"c {CVSS}", c=None) is None
