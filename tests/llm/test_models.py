import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from vulnspark.llm import pitman_yor, toxicity
from vulnspark.llm.pitman_yor import Seating


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Words follow each other in a fixed order more often than not."""
    rng = random.Random(2)
    names = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        w, out = rng.randrange(40), []
        for _ in range(60):
            w = (w * 7 + 3) % 40 if rng.random() < 0.8 else rng.randrange(40)
            out.append(names[w] if rng.random() < 0.97 else f"rare{rng.randrange(400)}")
        rows.append((i, " ".join(out)))
    path = str(tmp_path_factory.mktemp("texts") / "t")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


SMALL = pitman_yor.Settings(dishes=30, held=35, burn_in=2, samples=2)


@pytest.fixture(scope="module")
def language(texts):
    return pitman_yor.fit(texts.filter("doc_id % 7 <> 2"), s=SMALL)


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def test_counts_and_base(texts, language):
    model, words = language
    counts = {}
    for r in texts.filter("doc_id % 7 <> 2").collect():
        for w in tokens(r["text"]):
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    assert (model.tokens, model.types, words.count()) == (total, len(counts), len(counts))
    found = {r["doc_id"]: r for r in pitman_yor.score(texts, model, words, ["doc_id"]).collect()}
    for r in texts.collect():
        w, f = tokens(r["text"]), found[r["doc_id"]]
        assert f["n_tokens"] == len(w) and f["n_known"] == sum(x in counts for x in w)
        base = sum(math.log10((counts.get(x, 0) + 1) / (total + len(counts) + 1)) for x in w)
        assert math.isclose(f["base_score"], base, rel_tol=1e-9)


def test_beats_counts_on_held_out_texts(texts, language):
    scored = pitman_yor.score(texts, *language, ["doc_id"])
    row = pitman_yor.perplexity(scored, scored["doc_id"] % 7 == 2).first()
    assert row["perplexity"] < 0.5 * row["base_perplexity"]


def test_probabilities_add_up_to_one(language):
    model, _ = language
    width = model.lexicon.dishes + 1
    for context in range(width + 1):
        codes = context * width + np.arange(width)
        assert math.isclose((10 ** model.pair_scores(codes)).sum(), 1.0, rel_tol=1e-6)
    new, each = model.rare(0)
    rare_known = model.rare_types * new + each * (model.rare_tokens - model.rare_discount * model.rare_types)
    assert math.isclose(rare_known + new, 1.0, rel_tol=1e-9)


def test_seats_keep_their_customers():
    rng = np.random.default_rng(1)
    restaurant, dish = np.repeat(np.arange(5), 8), np.tile(np.arange(8), 5)
    customers = rng.integers(1, 500, 40)
    seats = Seating(restaurant, dish, customers)
    parent = np.full(8, 1 / 8)
    seats.begin(rng, parent, 0.5, 1.0)
    for _ in range(20):
        seats.gibbs(rng, parent, 0.5, 1.0, 5)
        assert (np.add.reduceat(seats.sizes, np.cumsum(seats.count) - seats.count) == customers).all()
        assert (seats.sizes > 0).all() and (seats.tables() <= customers).all()
    again = Seating(restaurant, dish, customers, seats.rows())
    assert (again.sizes == seats.sizes).all()


def test_a_restaurant_follows_its_customers():
    """Who stays keeps the seat; tables come and go with those who come and leave."""
    rng = np.random.default_rng(3)
    dish = np.arange(6)
    before = np.array([1, 5, 40, 300, 7, 2])
    seats = Seating(np.zeros(6, np.int64), dish, before.copy())
    seats.begin(rng, np.full(6, 1 / 6), 0.5, 1.0)
    for after in (before + 25, np.array([1, 1, 90, 2, 7, 3]), before):
        seats.follow(rng, after, np.full(6, 1 / 6), 0.5, 1.0)
        rows = seats.rows()
        assert [sum(r) for r in rows] == after.tolist() and all(min(r) > 0 for r in rows)
        assert (seats.tables() == [len(r) for r in rows]).all()
    alone = Seating(np.zeros(6, np.int64), dish, before.copy(), [[n] for n in before.tolist()])
    alone.follow(rng, before, np.full(6, 1 / 6), 0.5, 1.0)
    assert alone.rows() == [[n] for n in before.tolist()]


def test_gibbs_agrees_with_exact_tables():
    """One dish with few customers: the share of samples with t tables against the exact law."""
    d, theta, p, c = 0.5, 1.0, 0.3, 4
    law = {}

    def seat(sizes, weight):
        if sum(sizes) == c:
            law[len(sizes)] = law.get(len(sizes), 0) + weight
            return
        seat([*sizes, 1], weight * (theta + d * len(sizes)) * p)
        for i, n in enumerate(sizes):
            seat([*sizes[:i], n + 1, *sizes[i + 1 :]], weight * (n - d))

    seat([1], theta * p)
    rng = np.random.default_rng(3)
    n = 4000
    seats = Seating(np.arange(n), np.zeros(n, np.int64), np.full(n, c))
    seats.gibbs(rng, np.array([p]), d, theta, 60)
    share = np.bincount(seats.tables(), minlength=c + 1) / n
    total = sum(law.values())
    assert all(abs(share[t] - w / total) < 0.03 for t, w in law.items())


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    model, words = pitman_yor.fit(odd_docs, s=SMALL)
    rows = pitman_yor.score(odd_docs, model, words, ["doc_id", "odd.name", "score", "d"]).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(tokens(r["text"])) for r in odd_docs.collect())
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in rows)
    nothing, none = pitman_yor.fit(no_docs, s=SMALL)
    rows = pitman_yor.score(odd_docs, nothing, none, ["doc_id"]).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) and r["base_score"] == 0 for r in rows)
    assert pitman_yor.score(no_docs, model, words, ["doc_id"]).collect() == []


# -- toxicity ---------------------------------------------------------------------

INSULTS = ["idiot", "moron", "worthless"]
FEW = toxicity.Settings(sample=400, buckets=1 << 13, steps=250)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng = random.Random(6)
    plain = ["".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    rows = []
    for i in range(500):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(INSULTS)
        rows.append((i, " ".join(w), int(toxic)))
    path = str(tmp_path_factory.mktemp("labelled") / "t")
    spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def classifier(labelled):
    learn = labelled.filter("doc_id % 5 <> 0")
    return toxicity.fit(labelled.drop("toxic"), learn.select("doc_id", "toxic"), "doc_id", "text", "toxic", FEW)


def test_held_out_accuracy(labelled, classifier):
    rows = toxicity.score(labelled.filter("doc_id % 5 = 0"), classifier, ["toxic"]).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in rows]) >= 0.95


def test_unseen_misspellings_share_subwords(classifier):
    plain, spelled = classifier.word_scores([b"bonadel", b"idiiot"]), classifier.word_scores([b"bonadel", b"morron"])
    assert plain[1] > plain[0] and spelled[1] > spelled[0]


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, classifier):
    rows = toxicity.score(odd_docs, classifier, ["doc_id", "score", "odd.name"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(no_docs, classifier, ["doc_id"]).collect() == []
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 5), (99, 1)], "doc_id long, toxic int")
    neutral = toxicity.fit(odd_docs, labels, "doc_id", "text", "toxic", FEW)
    assert {r["score"] for r in toxicity.score(odd_docs, neutral, ["doc_id"]).collect()} == {0.5}
    labels = spark.createDataFrame([(11, 0), (11, 1), (3, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(odd_docs, labels, "doc_id", "text", "toxic", FEW)


def test_sample_is_bounded(labelled):
    model = toxicity.fit(labelled, labelled.select("doc_id", "toxic"), "doc_id", "text", "toxic", toxicity.Settings(sample=10, buckets=1 << 10, steps=5))
    assert model.vectors.shape == (1 << 10, 4)


def test_training_takes_little_memory():
    """Steps over many different words hold one dimension of their subwords at a time."""
    rng = random.Random(2)
    bags = []
    for y in (0, 1) * 32:
        found = list({"".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(1500)})
        bags.append((" ".join(found).encode(), np.ones(len(found), np.int32).tobytes(), y))
    tracemalloc.start()
    toxicity.train_bags(iter(bags), toxicity.Settings(epochs=1, steps=1, buckets=1 << 12))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 85e6
