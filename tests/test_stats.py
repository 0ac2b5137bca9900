"""Statistics against brute force."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vulnspark.operators import filters, stats


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def check_describe(spark, values):
    row = stats.describe(column(spark, values), "x").first()
    known = np.array([v for v in values if v is not None])
    assert row["count"] == len(known)
    assert row["mean"] == pytest.approx(known.mean(), rel=1e-9, abs=1e-9)
    if len(known) > 1:
        assert row["std"] == pytest.approx(known.std(ddof=1), rel=1e-6, abs=1e-9)
    else:
        assert row["std"] is None
    got = [row["min"], row["p25"], row["p50"], row["p75"], row["max"]]
    assert got == pytest.approx(list(np.percentile(known, [0, 25, 50, 75, 100])), rel=1e-12, abs=1e-12)


def test_describe_fixture(spark):
    row = stats.describe(column(spark, [1.0, 2.0, 4.0, None]), "x").first()
    assert [round(v, 6) for v in row] == [3, 2.333333, 1.527525, 1, 1.5, 2, 3, 4]


@pytest.mark.parametrize("seed", range(3))
def test_describe_random(spark, seed):
    r = random.Random(seed)
    hot = [7.5] * 400
    check_describe(spark, hot + [r.lognormvariate(0, 4) for _ in range(800)] + [None] * 5)


def test_describe_edges(spark):
    check_describe(spark, [3.0])
    check_describe(spark, [5.0] * 10)
    check_describe(spark, [0.0, 1e300, 1e-300, 1.0])
    row = stats.describe(column(spark, [None, None]), "x").first()
    assert row["count"] == 0 and row["mean"] is None and row["p50"] is None


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50).map(lambda i: i / 4), min_size=2, max_size=40))
def test_describe_property(spark, values):
    check_describe(spark, values)


def test_histogram_ends(spark):
    found = stats.histogram(column(spark, [0.0, 9.9, 10.0, 9.0, None, 11.0, -1.0]), "x").collect()
    assert [tuple(r) for r in found] == [(-1.0, 1), (0.0, 1), (9.0, 1), (9.5, 2), (11.0, 1)]


def test_dense_counts_is_case_sensitive(spark):
    df = column(spark, ["HIGH", "HIGH", "low", "unknown", None], "string")
    levels = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert [tuple(r) for r in stats.dense_counts(df, "x", levels).collect()] == [
        ("LOW", 0), ("MEDIUM", 0), ("HIGH", 2), ("CRITICAL", 0)]
    cross = stats.dense_crosstab(df, F.lit("a"), F.upper("x"), ["a", "b"], levels).collect()
    assert {(r.row, r.col): r.n for r in cross if r.n} == {("a", "HIGH"): 2, ("a", "LOW"): 1}


def test_ties_and_nulls(spark):
    df = column(spark, ["b", "a", None, "c", "c"], "string")
    assert [tuple(r) for r in stats.value_counts(df, "x").collect()] == [("c", 2), ("a", 1), ("b", 1)]
    assert stats.value_counts(df, "x", dropna=False).count() == 4
    shares = stats.shares(df, "x").collect()
    assert sum(r.share for r in shares) == pytest.approx(1)
    assert [r.x for r in stats.ordered_counts(df, "x", ["b", "c"]).collect()] == ["b", "c", "a"]


def test_combined_and_exploded(spark):
    df = column(spark, ["a, b", "a", "N/A", "a, b"], "string")
    assert [tuple(r) for r in stats.top_present(df, "x").collect()] == [("a, b", 2), ("a", 1)]
    assert [tuple(r) for r in stats.exploded_counts(df, "x").collect()] == [("a", 3), ("b", 2)]


def test_empty_input(spark):
    none = column(spark, [], "double")
    assert stats.row_count(none).first().n == 0
    assert stats.any_null(none, F.col("x")).first().any_null is False
    assert stats.summary(none, {"m": "x"}).first().m is None
    figures = stats.key_figures(none.select(F.lit("High").alias("s"), "x"), "s", "x").first()
    assert (figures.total, figures.mean_score) == (0, "N/A")


def test_filters_commute(spark):
    rows = [(s, a, v) for s in ("High", "Low", "Unknown") for a in ("Sql Injection", "Xss") for v in (None, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "severity string, attack_type string, cvss_score double")
    whole = filters.dashboard_filter(df, ["High", "Low"], ["Sql Injection"], 0.5)
    steps = filters.any_of(filters.min_score(df, "cvss_score", 0.5), "attack_type", ["Sql Injection"])
    steps = filters.any_of(steps, "severity", ["High", "Low"])
    assert sorted(whole.collect()) == sorted(steps.collect()) and whole.count() == 2
    assert filters.dashboard_filter(df).count() == 12
    assert filters.dashboard_filter(df, [], ["SQL injection"]).count() == 0
    assert filters.dashboard_filter(df, [], ["SQL injection"], case_insensitive=True).count() == 9


def test_describe_with_a_heavy_tail(spark):
    import random

    rng = random.Random(1)
    check_describe(spark, [rng.random() for _ in range(3000)] + [1e300, 1e150, 1e60])


def test_separator_is_plain_text(spark):
    df = spark.createDataFrame([("ab|cd|ab",)], "x string")
    assert {tuple(r) for r in stats.exploded_counts(df, "x", "|").collect()} == {("ab", 2), ("cd", 1)}


def test_describe_beyond_the_sketch(spark):
    """More rows than the sketch tells apart: brackets decide, the exact pass finds the ranks."""
    import random

    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(4000)] + [0.25] * 1500 + [None] * 7
    present = sorted(v for v in values if v is not None)
    for accuracy in (50, 400):
        row = stats.describe(column(spark, values), "x", accuracy=accuracy).first()
        assert (row["count"], row["min"], row["max"]) == (len(present), present[0], present[-1])
        for q, found in ((0.25, row.p25), (0.5, row.p50), (0.75, row.p75)):
            at = q * (len(present) - 1)
            low, high = present[int(at)], present[min(int(at) + 1, len(present) - 1)]
            assert found == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)


def test_describe_reads_twice(spark):
    plan = stats.describe(column(spark, [1.0, 2.0]), "x")._jdf.queryExecution().sparkPlan().toString()
    assert "Subquery" not in plan


def test_fitted_histogram(spark):
    def bins(values, most=20):
        return [tuple(r) for r in stats.fitted_histogram(column(spark, values), "x", most).collect()]

    tenths = [i / 10 for i in range(0, 101)]
    found = bins(tenths + [None, float("nan"), float("inf")])
    assert len(found) == 20 and {w for _, w, _ in found} == {0.5} and sum(n for *_, n in found) == 101
    assert found[0] == (0.0, 0.5, 5) and found[-1] == (9.5, 0.5, 6)
    assert bins([3.0, 3.0, None]) == [(3.0, 1.0, 2)]
    assert bins([]) == []
    for values in ([-7.3, 12.9, 0.0], [1e9, 5e12], [0.001, 0.0012, 0.0019]):
        found = bins(values)
        assert sum(n for *_, n in found) == len(values) and len({b for b, _, _ in found}) <= 20
        width = found[0][1]
        assert math.ceil(max(values) / width) - math.floor(min(values) / width) <= 20


def test_the_first_date_decides_the_format(spark):
    def days(values):
        df = spark.createDataFrame(list(enumerate(values)), "at int, x string").repartition(3)
        return [None if r.day is None else str(r.day) for r in stats.with_inferred_days(df, "x", ["at"]).orderBy("at").collect()]

    assert days(["soon", "13/02/2024", "03/04/2024", "2024-01-05", None]) == [None, "2024-02-13", "2024-04-03", None, None]
    assert days(["03/04/2024", "13/02/2024"]) == ["2024-03-04", None]
    assert days([" 2024-1-5 ", "2024-01-05T10:00:00", "5 Jan 2024"]) == ["2024-01-05", None, None]
    assert days(["Jan 5, 2024", "x"]) == ["2024-01-05", None]
    assert days([None, "x"]) == [None, None] and days([]) == []
