"""Text rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from vulnspark.functions import text

def T():
    return F.col("t")



@pytest.mark.parametrize(
    "given, expected",
    [
        ("Title: [Foo](http://x) sql_api.py _load_db  SQL Injection via injection in x", "Foo SQL Injection in x"),
        ("Title:  ", "unknown"),
        ("run.py _x", ""),
        ("éa.py INJECTION a\nInjection", "INJECTION a Injection"),
        ("a.pyx.py z", "a. z"),
        ("injectionx injection", "injectionx injection"),
        (None, "unknown"),
        ("", "unknown"),
    ],
)
def test_clean_title(value, given, expected):
    assert value(text.clean_title(T()), t=given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("3com", "com"), ("--acme 2", "acme 2"), ("_x", "_x"), ("n/a", "n/a"), ("123", "Unknown"),
     ("123 élan", "élan"), ("", "Unknown"), (None, "Unknown"), ("　x ", "x")],
)
def test_vendor_name(value, given, expected):
    assert value(text.vendor_name(T()), t=given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("it's cross-site éa x2y", "It'S Cross-Site Éa X2Y"), ("SQL  injection", "Sql Injection"),
     ("ßa", "Ssa"), (" \t", ""), ("中a", "中A")],
)
def test_attack_name(value, given, expected):
    assert value(text.attack_name(T()), t=given) == expected


def test_title_case_equals_python(spark):
    samples = ["o'neil mcX", "2nd CROSS-site", "éÀ ça", "a_b c1d", "x　y", "ñandú ÑANDÚ", "ªa"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string")
    found = [r["v"] for r in rows.select(text.title_case(T()).alias("v")).collect()]
    assert found == [s.title() for s in samples]


@pytest.mark.parametrize(
    "given, expected",
    [("a\r\n\tb   c ", "a b c"), (None, ""), ("", ""), (" x ", "x")],
)
def test_flat_text(value, given, expected):
    assert value(text.flat_text(T()), t=given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("2024-01-05", "2024-01-05"), ("2024-1-5", "2024-01-05"), ("2024-13-01", None), ("2024-1-5x", None),
     ("", None), (None, None), ("2023-02-29", None)],
)
def test_iso_date(value, given, expected):
    found = value(text.iso_date(T()), t=given)
    assert (found.isoformat() if found else None) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("9.8", 9.8), (" 7 ", 7.0), ("-.5", -0.5), ("5.", 5.0), ("1e1", 10.0), (" 7　", 7.0),
     ("7.5d", None), ("nan", None), ("inf", None), ("x", None), ("", None), (None, None)],
)
def test_number(value, given, expected):
    assert value(text.number(T()), t=given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [(None, "N/A"), (" ", "N/A"), ("unknown", "N/A"), ("Unknown", "N/A"), ("UNKNOWN", "UNKNOWN"), (" a ", "a")],
)
def test_present_or(value, given, expected):
    assert value(text.present_or(T(), "N/A"), t=given) == expected


def test_small_rules(value):
    assert value(text.link_labels(T()), t="see [a b](http://x/(1) and [c](d)") == "see a b and c"
    assert value(text.link_labels(T()), t=None) == "unknown"
    assert value(text.correct(T(), {"PromtEngineer": "PromptEngineer"}), t=" PromtEngineer ") == "PromptEngineer"
    assert value(text.correct(T(), {"a": "b"}), t=None) == ""
    assert value(text.or_empty(T()), t=" a ") == "a"
    assert value(text.capitalize(T()), t="ßCRITICAL") == "Sscritical"
    assert value(text.fixed(F.lit(0.25), 1), t="") == "0.2"
    assert value(text.fixed(F.lit(1234567.35), 1), t="") == "1234567.4"
    assert value(text.is_unknown(T()), t="UnKnown") is True
    assert value(text.is_unknown(T()), t=None) is False
    assert value(text.one_of_levels(T(), ["LOW", "HIGH"]), t="HIGH") == 2
    assert value(text.one_of_levels(T(), ["LOW", "HIGH"]), t="ODD") is None
