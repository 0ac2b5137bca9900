import random

import pytest
from pyspark.sql import functions as F

from vulnspark.llm import exact_search
from vulnspark.llm.exact_search import top_k


def brute(rows, k):
    width = max((len(v) for _, v in rows), default=0)
    full = [(i, v + [0] * (width - len(v))) for i, v in rows]
    out = []
    for q, (i, a) in enumerate(full):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), j) for r, (j, b) in enumerate(full) if r != q)[:k]
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def vectors(n, width, top, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.randint(-top, top) for _ in range(width)]) for i in range(n)]


def found(spark, rows, k):
    frame = spark.createDataFrame(rows, "id long, v array<long>").withColumn("score", F.lit("clash"))
    return sorted(tuple(r) for r in top_k(frame, F.col("id") % 20 == 0, k).collect())


@pytest.mark.parametrize("width, top", [(7, 3), (16, 40), (6, 900_000_000)])
def test_against_brute_force(spark, monkeypatch, width, top):
    monkeypatch.setattr(exact_search, "PACK_ROWS", 64)
    monkeypatch.setattr(exact_search, "QUERY_ROWS", 4)
    rows = vectors(230, width, top)
    assert found(spark, rows, 9) == brute(rows, 9)


def test_ties_repeats_and_short_vectors(spark):
    rows = vectors(60, 4, 1) + [(20, [1, 1, 1, 1]), (20, [1, 1, 1, 1]), (41, [5]), (42, [])] + [(i, [1, 0, 0, 0]) for i in range(100, 160)]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_many_equal_vectors(spark, monkeypatch):
    """A third of all rows ties at the cutoff; ties go to the smaller ids, cell by cell."""
    monkeypatch.setattr(exact_search, "PACK_ROWS", 32)
    monkeypatch.setattr(exact_search, "QUERY_ROWS", 4)
    rows = vectors(80, 4, 2) + [(i, [2, 2, 2, 2]) for i in range(200, 360)]
    assert found(spark, rows, 7) == brute(rows, 7)


def test_fewer_candidates_nulls_and_nothing(spark):
    rows = vectors(5, 3, 9)
    assert found(spark, rows, 20) == brute(rows, 20)
    odd = [*rows, (None, [1, 2, 3]), (7, None), (8, [1, None, 3])]
    assert found(spark, odd, 20) == brute(rows, 20)
    assert found(spark, [], 20) == []
    assert found(spark, [(0, [1])], 20) == []


def test_no_pack_is_broadcast(spark, monkeypatch):
    """Copies of the packs, one for every pack of the other side, never gather on the driver."""
    monkeypatch.setattr(exact_search, "PACK_ROWS", 16)
    monkeypatch.setattr(exact_search, "QUERY_ROWS", 4)
    plans, stored = [], exact_search.stored

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(exact_search, "stored", noted)
    frame = spark.createDataFrame(vectors(100, 4, 9), "id long, v array<long>")
    plans.append(top_k(frame, F.col("id") % 20 == 0, 5)._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans)
    assert sum("SortMergeJoin" in p for p in plans) == 2
