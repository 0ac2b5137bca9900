import re

from vulnspark.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, n):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in grams:
                    hit.update(range(i, i + size))
                    found |= grams[g]
        out.append((len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def items(odd_docs):
    long = next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 6)
    w = long.split()
    return [(1, " ".join(w[10:30]).upper()), (2, "the the"), (3, None), (4, ""), (None, " ".join(w[60:75])), (10, " ".join(w[20:32])), (10, " ".join(w[20:32]))]


def same(found, expected):
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in found] == expected


def test_against_brute_force(spark, odd_docs):
    bench = spark.createDataFrame(items(odd_docs), "item_id long, text string")
    rows = odd_docs.select("text").collect()
    expected = brute([r["text"] for r in rows], items(odd_docs), 10)
    found = decontaminate(odd_docs, bench, ["doc_id", "text", "odd.name"]).collect()
    same(found, expected)
    assert [r["text"] for r in found] == [r["text"] for r in rows]
    for r, (_, n_hit, _) in zip(found, expected):
        assert (r["clean_text"] == r["text"]) == (n_hit == 0)
        assert not r["text"] or len(words(r["clean_text"])) == r["n_words"] - n_hit


def test_blocks_give_the_same(spark, odd_docs):
    bench = spark.createDataFrame(items(odd_docs), "item_id long, text string")
    one = decontaminate(odd_docs, bench, ["doc_id"]).collect()
    many = decontaminate(odd_docs, bench, ["doc_id"], broadcast_windows=7).collect()
    key = lambda r: (r["doc_id"] or -1, r["n_words"], r["n_hit"])
    assert sorted(one, key=key) == sorted(many, key=key)


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate(odd_docs, none, ["doc_id"]).collect()} == {0}
    assert decontaminate(no_docs, none, ["doc_id"]).collect() == []
