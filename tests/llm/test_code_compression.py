"""Product quantisation over active entries against plain Lloyd rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from vulnspark.llm import code_compression
from vulnspark.llm.code_compression import Settings, assign, compress

SCHEMA = "vec_id long, embedding array<float>, label int, v int, code int, far string, `a.b` int"


def plain(rows, settings):
    """Every part compared with every entry in every round."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % settings.parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // settings.parts
    v = [[math.floor(settings.scale * x) for x in r[1]] for r in kept]
    parts = [[x[p * width : (p + 1) * width] for x in v] for p in range(settings.parts)]
    books = [[list(x) for x in parts[p][: settings.entries]] for p in range(settings.parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(settings.rounds):
        for p in range(settings.parts):
            groups = {}
            for x in parts[p]:
                groups.setdefault(nearest(p, x)[1], []).append(x)
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found = []
    for i, r in enumerate(kept):
        best = [nearest(p, parts[p][i]) for p in range(settings.parts)]
        found.append((r[0], bytes(b[1] for b in best).hex(), sum(b[0] for b in best)))
    flat = ",".join(str(x) for p in books for c in p for x in c)
    return sorted(found, key=repr), hashlib.sha256(flat.encode()).hexdigest()


def run(spark, rows, settings):
    df = spark.createDataFrame([(*r, 1, 2, "f", 3) for r in rows], SCHEMA).repartition(3)
    found = compress(df, ["vec_id", "code", "v", "a.b"], settings=settings)
    assert found.vectors.columns == ["vec_id", "v", "a.b", "code", "error"]
    return sorted([(r["vec_id"], bytes(r["code"]).hex(), r["error"]) for r in found.vectors.collect()], key=repr), found.digest()


def vectors(seed, n, dims, grid):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [
        (i, [round((c + rng.gauss(0, 0.5)) * grid) / grid for c in rng.choice(centres)], rng.choice([1, 2, None]))
        for i in rng.sample(range(10 * n), n)
    ]


@pytest.mark.parametrize("seed, grid", [(1, 1000.0), (2, 2.0)])
def test_equal_to_plain_rounds(spark, seed, grid):
    """Coarse values make ties between entries."""
    settings = Settings(parts=4, entries=8, rounds=5)
    rows = vectors(seed, 300, 8, grid)
    assert run(spark, rows, settings) == plain(rows, settings)


def test_odd_vectors(spark):
    settings = Settings(parts=4, entries=16, rounds=6)
    good = vectors(3, 12, 8, 10.0)
    bad = [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 2), (904, [], 1),
           (905, [1.0] * 7, 1), (906, [1.0] * 12, None)]
    rows = good + bad + [good[0], good[0], (None, [0.25] * 8, 1), (None, [-0.25] * 8, None)]
    assert run(spark, rows, settings) == plain(rows, settings)
    df = spark.createDataFrame([(*r, 1, 2, "f", 3) for r in bad[:6]], SCHEMA)
    assert compress(df, ["vec_id"], settings=settings) is None
    assert compress(df.limit(0), ["vec_id"]) is None


def test_huge_components_stop_at_the_bound(spark):
    rows = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.5] * 8, 1)]
    found, _ = run(spark, rows, Settings(entries=1, rounds=1))
    assert all(error >= 0 for _, _, error in found)


def test_parts_with_a_fixed_entry_meet_moved_entries_only(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (200, 2, 3))
    old = rng.integers(-50, 50, (2, 6, 3))
    moved = np.zeros((2, 6), bool)
    moved[:, [1, 4]] = True
    code, far = assign(x, old, np.ones((2, 6), bool), None, None)
    new = old + moved[:, :, None] * rng.integers(-9, 9, (2, 6, 3))
    seen = []
    scan = code_compression._scan
    monkeypatch.setattr(code_compression, "_scan", lambda a, b, which: seen.append((len(a), len(which))) or scan(a, b, which))
    fast = assign(x, new, moved, code, far)
    whole = assign(x, new, np.ones((2, 6), bool), None, None)
    assert (fast[0] == whole[0]).all() and (fast[1] == whole[1]).all()
    assert sum(n for n, k in seen[:4] if k == 6) == int(np.isin(code, [1, 4]).sum())
