import collections
import random

import pytest

from vulnspark.llm import substring_dedup, suffix_dedup
from vulnspark.llm.substring_dedup import remove_repeated_words
from vulnspark.llm.suffix_dedup import remove_repeats, repeats


def cut_bytes(texts, width):
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = set()
        for i in range(len(b) - width + 1):
            if counts[b[i : i + width]] > 1:
                gone.update(range(i, i + width))
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(b), len(gone), runs, bytes(c for i, c in enumerate(b) if i not in gone)))
    return out


def same_bytes(df, width, gram):
    rows = df.collect()
    found = remove_repeats(df, ["doc_id", "odd.name"] if "odd.name" in df.columns else ["doc_id"], width, gram=gram).collect()
    expected = sorted((r["doc_id"] or -1, *x) for r, x in zip(rows, cut_bytes([r["text"] for r in rows], width)))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in found) == expected


@pytest.mark.parametrize("width, gram", [(400, 64), (60, 10), (12, 12)])
def test_bytes_of_odd_rows(odd_docs, width, gram):
    same_bytes(odd_docs, width, gram)


def test_sifted_texts_are_cut_alike(odd_docs):
    cut = lambda **how: sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in remove_repeats(odd_docs, ["doc_id"], 60, gram=10, **how).collect())
    assert cut(sift=True) == cut()


def mutated(n, seed=3):
    """Copies with edits, over a small alphabet: many repeats that begin and end anywhere."""
    rng = random.Random(seed)
    base = "".join(rng.choice("ab ") for _ in range(300))
    out = []
    for i in range(n):
        t = list(base[rng.randint(0, 60) : rng.randint(200, 300)])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcd\0")
        out.append((i, "".join(t)))
    return out


@pytest.mark.parametrize("limit", [60_000, 5])
def test_bytes_of_edited_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", limit)
    same_bytes(spark.createDataFrame(mutated(80), "doc_id long, text string"), 40, 8)


@pytest.mark.parametrize("others", [False, True])
@pytest.mark.parametrize("bits", [1 << 28, 1 << 15])
def test_joined_texts(spark, monkeypatch, bits, others):
    """Few of the texts that have no partner are shuffled, and none of those that have one is lost."""
    monkeypatch.setattr(suffix_dedup, "MOST_BITS", bits)
    rows = spark.range(20_000).selectExpr("id d", "-id t", "cast(id AS string) text")
    found = spark.range(0, 30_000, 7).selectExpr("id d", "-id t", "id * 2 AS x")
    joined = suffix_dedup._joined_to(rows, found, "x", others).collect()
    assert sorted((r["d"], r["x"]) for r in joined) == [(i, 2 * i if i % 7 == 0 else None) for i in range(20_000) if others or i % 7 == 0]


def test_repeats_of_a_group():
    rng = random.Random(8)
    for _ in range(60):
        members = list({("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode(), "".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode()) for _ in range(9)})
        lefts, rights = zip(*members)
        found = repeats(list(lefts), list(rights), 8)
        strings = [{x: left[:x][::-1] + right[: 8 - x] for x in range(len(left) + 1) if 0 < 8 - x <= len(right)} for left, right in members]
        for i, ranges in enumerate(found):
            covered = {x for a, b in ranges for x in range(a, b + 1)}
            expected = {x for x, s in strings[i].items() if any(strings[j].get(x) == s for j in range(len(members)) if j != i)}
            assert covered == expected


def cut_words(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in words:
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            first[g] = min(first.get(g, float("inf")), key(i))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if key(i) > first[tuple(w[p : p + width])]:
                gone.update(range(p, p + width))
        out.append((-1 if i is None else i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("width, block, group", [(13, 6 << 20, 1_500_000), (13, 4_000, 50), (2, 4_000, 50), (1, 2_000, 20)])
def test_words_of_odd_rows(odd_docs, monkeypatch, width, block, group):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring_dedup, "GROUP_SUFFIXES", group)
    found = remove_repeated_words(odd_docs, ["doc_id", "odd.name", "n_words", "d"], width).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found) == cut_words(rows, width)


def test_empty_tables(no_docs):
    assert remove_repeats(no_docs, ["doc_id"]).collect() == []
    assert remove_repeated_words(no_docs, ["doc_id"]).collect() == []
