import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from vulnspark.llm.packing import Capacity, Words, best_fit, pack, token_pieces
from vulnspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_words_give_the_tokenizer_s_ids(tokenizer):
    rng = random.Random(3)
    signs = list("aAbBzZ'sS019 .,;-éÉ́İıſßΣσ中—­  \x0b\x0c\x1c\x85\t\n<|>#$ªº²½ŉµKẞ") + ["'re", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|end", "İ", "\U0001f600"]
    words = Words(tokenizer_path())
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14)))
        assert words.of([text.encode()])[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_many_words_at_once(tokenizer):
    rng = random.Random(4)
    signs = list("abcXYZ012.,'-é中<|> ") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    found = Words(tokenizer_path()).of([t.encode() for t in texts])
    assert found == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    plain = [f"{a}{b}{c} {d}" for a in ("Été", "abc", "12", "") for b in ("...", ",", "_x", "×", "'s", "÷") for c in ("ŒUVRE", "ß9", "") for d in ("", "ſt", "İ", "ı!", "a\x1cb")]
    found = Words(tokenizer_path()).of([t.encode() for t in plain])
    assert found == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in plain]
    assert Words(tokenizer_path()).of([b"a <|endoftext|> b"])[0] == np.array([320, 49407, 321], "<u4").tobytes()


def well_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        lengths = [n for _, n in parts]
        assert sum(lengths) <= capacity.tokens and len(parts) <= capacity.documents
        assert sum(n * n for n in lengths) <= capacity.attention
    return len(bins)


def test_odd_documents(odd_docs, no_docs, tokenizer):
    rows = pack(token_pieces(odd_docs, ["doc_id", "odd.name"], tokenizer_path(), most=512), Capacity(tokens=512)).collect()
    ids = [[*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in odd_docs.collect()]
    expected = sorted(
        (i, a, len(x[a : a + 512]), zlib.crc32(np.array(x[a : a + 512], "<u4").tobytes()))
        for x in ids for i, a in enumerate(range(0, len(x), 512))
    )
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    well_packed(rows, Capacity(tokens=512))
    assert pack(token_pieces(no_docs, ["doc_id"], tokenizer_path())).collect() == []


def test_ids_come_back(odd_docs, tokenizer):
    rows = token_pieces(odd_docs, ["doc_id"], tokenizer_path(), ids=True).filter("doc_id = 8").collect()
    text = odd_docs.filter("doc_id = 8").first()["text"]
    ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert {bytes(r["ids"]) for r in rows} == {ids}


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [dict(tokens=100), dict(tokens=100, documents=3), dict(tokens=100, attention=2600)])
def test_every_constraint_holds(spark, rule, capacity):
    c = Capacity(**capacity, rule=rule)
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 3, 10, 17, 33, 50])) for i in range(700)]
    out = pack(spark.createDataFrame(rows, "doc long, length long"), c).collect()
    assert sorted((r["doc"], r["length"]) for r in out) == sorted(rows)
    bins = well_packed(out, c)
    if c.documents == 4096 and c.attention > 10_000:
        assert bins <= 1.03 * sum(n for _, n in rows) / 100 + 1


def test_same_plan_as_one_piece_at_a_time():
    rng = random.Random(9)
    lengths = [rng.randint(1, 60) for _ in range(400)]
    histogram = [(n, lengths.count(n)) for n in set(lengths)]
    plan = best_fit(histogram, Capacity(tokens=64))
    bins = 1 + max(first + (hi - lo - 1) // per for _, lo, hi, per, first, _ in plan)
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i] - n)] -= n
        else:
            free.append(64 - n)
    assert bins <= len(free) + 1


def test_one_length_for_a_third(spark):
    rows = [(i, 64 if i % 3 == 0 else 1 + i % 7) for i in range(3000)]
    out = pack(spark.createDataFrame(rows, "doc long, length long"), Capacity(tokens=64)).collect()
    assert len(out) == 3000
    well_packed(out, Capacity(tokens=64))
