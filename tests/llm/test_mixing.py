"""Mixing: targets and permutations against brute force, and the laws of the mix."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vulnspark.llm import mixing, running
from vulnspark.llm.mixing import Settings, mix, permuted

SCHEMA = "doc_id long, text string, source string, size int, target string, start int, k0 int, `a.b` int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, 3, 4) for r in rows], SCHEMA).repartition(3)


def corpus(seed, n, sources):
    rng = random.Random(seed)
    words = ["a", "bé", "c d", "e-f"]
    return [
        (rng.choice([i, None]) if rng.random() < 0.1 else i,
         rng.choice([None, "", " \t"]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))),
         rng.choice(sources))
        for i in range(n)
    ]


def n_words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def wanted(rows, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += n_words(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, excess, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while free and excess > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += excess * weight[s] / total
        excess = 0.0
        for s in sorted(free, key=str):
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
    return sizes, target


def check(spark, rows, settings):
    result = mix(docs(spark, rows), ["source", "doc_id", "text", "size", "a.b"], settings=settings)
    found = result.taken().collect()
    assert result.documents.columns[:4] == ["source", "doc_id", "text", "a.b"]
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in found) == Counter(rows)
    sizes, target = wanted(rows, settings.weights, settings.most)
    taken = Counter()
    for r in found:
        assert r["size"] == n_words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= settings.most * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6
    return result, found


@pytest.mark.parametrize("seed, sources", [(1, ["x", "y", None]), (2, ["s%d" % i for i in range(12)] + ["hot"] * 12)])
def test_targets_are_met_word_by_word(spark, seed, sources):
    check(spark, corpus(seed, 200, sources), Settings(block=7, slots=50))


def test_a_small_source_stops_at_three_times_its_size(spark):
    rows = [(1, "one two three", "b"), (2, "w " * 500, "a"), (3, "v " * 400, "c"), (4, None, "empty")]
    _, found = check(spark, rows, Settings(block=4, slots=16))
    assert {r["doc_id"]: r["taken"] for r in found}[1] == 9


def test_slots_and_pieces_agree_and_passes_are_whole(spark):
    settings = Settings(block=5, slots=20)
    result, _ = check(spark, corpus(4, 120, ["x", "y", "z"]), settings)
    slots = result.slots.collect()
    by_slot = defaultdict(int)
    for p in result.pieces.collect():
        by_slot[p["number"], p["slot"]] += p["length"]
    assert by_slot == {(s["number"], s["slot"]): s["words"] for s in slots}
    assert max(Counter(s["shard"] for s in slots).values()) <= 20 * 3
    for number in {s["number"] for s in slots}:
        mine = sorted((s["slot"], s["turn"], s["block"]) for s in slots if s["number"] == number)
        assert [m[0] for m in mine] == list(range(len(mine)))
        turns = defaultdict(list)
        for _, turn, block in mine:
            turns[turn].append(block)
        for turn, blocks in turns.items():
            assert len(set(blocks)) == len(blocks)
            if turn < max(turns):
                assert sorted(blocks) == list(range(len(blocks)))


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(5, 150, ["x", "y"]) + [(7, "same text here", "x")] * 3
    one = sorted(map(repr, mix(docs(spark, rows), ["doc_id", "text"], settings=Settings(block=6)).taken().collect()))
    two = sorted(map(repr, mix(docs(spark, rows).repartition(7), ["doc_id", "text"], settings=Settings(block=6)).taken().collect()))
    assert one == two


def test_bundles_and_hot_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUNDLE", 4)
    monkeypatch.setattr(running, "HOT_KEYS", 5)
    check(spark, corpus(6, 300, ["s%d" % i for i in range(11)] + ["hot"] * 9), Settings(block=3, slots=30))


def test_empty(spark):
    assert mix(docs(spark, []), ["doc_id"]).taken().collect() == []
    rows = mix(docs(spark, [(1, None, "x"), (2, "", None)]), ["doc_id"]).taken().collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in rows) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_a_very_long_document(spark):
    check(spark, [(1, "w " * 600_000, "x"), (2, "short one", "y"), (3, "z " * 50_000, "y")], Settings())


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 17, 1000, 4097])
def test_permutations_have_inverses(size):
    index = np.arange(size)
    for key in (0, 12345, 2**63):
        keys = np.full(size, key, np.uint64)
        there = permuted(index, np.full(size, size), keys)
        assert sorted(there.tolist()) == index.tolist()
        assert (permuted(there, np.full(size, size), keys, backward=True) == index).all()
