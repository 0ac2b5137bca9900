import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vulnspark.llm.simhash import link_groups, links, near_duplicates
from vulnspark.llm.components import components


def fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, within):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= within:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = [fingerprint(r["text"]) for r in rows]
    root = groups(fps, 2)
    least = {g: min((r["doc_id"] for r, x in zip(rows, root) if x == g and r["doc_id"] is not None), default=None) for g in root}
    expected = sorted((r["doc_id"] or -1, f, least[g] or -1) for r, f, g in zip(rows, fps, root))
    found = near_duplicates(odd_docs).collect()
    assert sorted((r["doc_id"] or -1, r["fp"] % (1 << 64), r["component"] or -1) for r in found) == expected
    assert near_duplicates(no_docs).collect() == []


def near_points(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    out = centres[rng.integers(0, 12, n)]
    for _ in range(4):
        out ^= np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(out)


@pytest.mark.parametrize("within, agree, limit", [(2, 1, 50_000), (2, 1, 20), (6, 2, 50_000), (3, 1, 10)])
def test_links_join_what_all_pairs_would(spark, within, agree, limit):
    fps = near_points(500)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components(links(frame, within, agree, limit)).collect()}
    signed = sorted(fps.view(np.int64).tolist())
    expected = groups([x % (1 << 64) for x in signed], within)
    assert [roots.get(x, x) for x in signed] == [signed[g] for g in expected]


def test_forest_is_linear_in_the_group():
    fps = np.arange(4096, dtype=np.uint64)
    a, b = link_groups(np.zeros(4096, np.uint64), fps, 2)
    assert len(a) == 4095 and set(b.tolist()) == {0}


def test_component_with_a_hot_node(spark):
    star = spark.range(1, 5000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    chain = spark.range(5000, 5200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = {r["node"]: r["root"] for r in components(star.unionByName(chain)).collect()}
    assert all(found[i] == 0 for i in range(1, 5000)) and all(found[i] == 5000 for i in range(5001, 5201))
