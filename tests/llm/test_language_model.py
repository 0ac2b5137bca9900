"""The language model knows every pair of words that training holds, not only those of frequent words."""

import math
import random

import numpy as np
import pytest

from vulnspark.llm import pitman_yor

SMALL = pitman_yor.Settings(dishes=5, held=20, burn_in=2, samples=2)


def written(spark, folder, texts):
    path = str(folder / "t")
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def scores(docs, model, words):
    return {r["doc_id"]: r for r in pitman_yor.score(docs, model, words, ["doc_id"]).collect()}


def test_pairs_beyond_the_frequent_words_are_learned(spark, tmp_path_factory):
    """a_i is always followed by b_i; all of them are as frequent as each other and none is a dish."""
    rng = random.Random(5)
    train = []
    for _ in range(400):
        i = rng.randrange(40)
        train.append(f"x y z x y a{i} b{i} z y")
    model, words = pitman_yor.fit(written(spark, tmp_path_factory.mktemp("train"), train), s=SMALL)
    asked = written(spark, tmp_path_factory.mktemp("asked"), ["x y a3 b3 z", "x y a3 b4 z", "x y a4 b3 z", "x y a4 b4 z"])
    s = {i: r["score"] for i, r in scores(asked, model, words).items()}
    assert s[0] + s[3] - s[1] - s[2] > 4  # the same words; two pairs that occur against two that do not


def one(text):
    return pitman_yor._tokens([text.encode()])[0].tolist()


@pytest.mark.parametrize("split", [False, True])
def test_every_context_against_plain_python(spark, tmp_path_factory, monkeypatch, split):
    """Counts, tables, sums to one and scores, each context's restaurant rebuilt from the stored table."""
    if split:  # several blocks, and contexts dealt among them
        monkeypatch.setattr(pitman_yor, "BLOCK", 700)
        monkeypatch.setattr(pitman_yor, "SPLIT", 150)
        monkeypatch.setattr(pitman_yor, "CHUNK", 10)
    rng = random.Random(3)
    texts = ["", "only"]
    for _ in range(150):
        texts.append(" ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(40))))
    texts += texts[:20]
    docs = written(spark, tmp_path_factory.mktemp("texts"), texts)
    model, words = pitman_yor.fit(docs, s=SMALL)
    assert (model.blocks > 1) == split and bool(len(model.hot[0])) == split

    begin, lex = int(pitman_yor.BEGIN), model.lexicon
    counts, pairs = {}, {}
    for t in texts:
        last = begin
        for w in one(t):
            counts[w] = counts.get(w, 0) + 1
            pairs[last, w] = pairs.get((last, w), 0) + 1
            last = w
    dish = {int(h): int(d) for h, d in zip(lex.hashes, lex.dish) if d < lex.dishes}
    dish[begin] = lex.dishes + 1
    own, customers, held = {}, {}, {}
    for r in model.seats.collect():
        cs = np.frombuffer(r["c"], np.uint64).tolist()
        n, t = np.frombuffer(r["cn"], "<f8").reshape(2, -1).tolist()
        ks = np.frombuffer(r["cr"], "<u4").tolist()
        ws = lex.unpack([r["w"]], [r["wr"]])[0].tolist()
        rest = np.frombuffer(r["v"], "<f4").tolist()
        at = 0
        for c, k, x, y in zip(cs, ks, n, t):
            customers[c], held[c] = customers.get(c, 0) + x, held.get(c, 0) + y
            for w, e in zip(ws[at : at + k], rest[at : at + k]):
                assert (c, w) not in own
                own[c, w] = e
            at += k
        assert at == len(ws) == len(rest)
    below = {p: n for p, n in pairs.items() if p[0] not in dish or p[1] not in dish}
    assert own.keys() == below.keys() and all(0 < e < below[p] for p, e in own.items())
    for c in customers:
        n = [m for p, m in below.items() if p[0] == c]
        assert customers[c] == sum(n)
        assert math.isclose(held[c], sum(n) - sum(e for p, e in own.items() if p[0] == c), rel_tol=1e-4)

    new, each = model.rare(0)
    width = lex.dishes + 1
    table = 10 ** model.pair_scores(np.arange((width + 1) * width)).reshape(width + 1, width)

    def p(c, w):
        i, j = dish.get(c, lex.dishes), dish.get(w, lex.dishes)
        if i != lex.dishes and j != lex.dishes:
            return table[i, j]
        share = new + (each * (counts[w] - model.rare_discount) if w in counts else 0.0) if j == lex.dishes else 1.0
        base = share if i != lex.dishes else table[i, j] * share
        n, t = customers.get(c, 0), held.get(c, 0)
        inside = (own.get((c, w), 0.0) + (model.strength + t) * base) / (model.strength + n)
        return inside * (table[i, lex.dishes] if i != lex.dishes else 1.0)

    unknown = one("never")[0]
    for c in [begin, unknown, *(w for w in counts if w != 1)]:
        assert math.isclose(sum(p(c, w) for w in [*counts, unknown]), 1.0, rel_tol=1e-5)
    asked = texts[:60] + ["never w1 never", "w0 w1 never w59 w58"]
    found = scores(written(spark, tmp_path_factory.mktemp("asked"), asked), model, words)
    for i, t in enumerate(asked):
        w = one(t)
        assert math.isclose(found[i]["score"], sum(math.log10(p(*x)) for x in zip([begin, *w], w)), rel_tol=1e-5)
        assert (found[i]["n_tokens"], found[i]["n_known"]) == (len(w), sum(x in counts for x in w))
