"""The segmented index against a plain search over all texts."""

import pathlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_search import STOP, plain_search, plain_terms, same

from vulnspark.operators import search, text_index
from vulnspark.operators.text_index import SegmentedIndex


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words[: rng.randint(2, 60)]) for _ in range(rng.choice([1, 3, 8, 40])))
        rows.append((f"d{i:04d}", text if i % 17 else None, rng.choice(["High", "Low", None]), rng.choice([None, 3.5, 7.0, 9.8])))
    return rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(text_index, "CELL_BITS", 3)
        rows = corpus(400)
        index = SegmentedIndex(spark, str(tmp_path_factory.mktemp("index")), ["severity", "score"], STOP)
        schema = "id string, text string, severity string, score double"
        index.add(spark.createDataFrame(rows[:250], schema).repartition(3), "id", search.corpus_text(["text"]))
        index.commit()
        first = [r for r in rows[:250]]
        some = index.search("w1 w2", 5).collect()
        same([(r.doc, r.relevance) for r in some], plain_search("w1 w2", [(r[0], r[1]) for r in first])[:5])
        index.add(spark.createDataFrame(rows[250:], schema), "id", search.corpus_text(["text"]))
        # Until the next commit the old generation answers.
        assert {r.doc for r in index.search("w1 w2", None).collect()} <= {r[0] for r in first}
        yield index.commit(), rows


QUERIES = ["w1 w2 w3", "w59 w0", "w5 w5 w6 zzz", "the w40 w41"]


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("top_k", [1, 10, None])
def test_as_a_full_scan(built, query, top_k):
    index, rows = built
    wanted = plain_search(query, [(r[0], r[1]) for r in rows])
    same([(r.doc, r.relevance) for r in index.search(query, top_k).collect()], wanted[:top_k])


def test_blocks_are_skipped(built):
    index, _ = built
    blocks, skipped = index.skipped("w59 w0", 3).first()
    assert 0 < skipped < blocks


def test_no_text_is_read(built):
    index, _ = built
    plan = index.search("w1", 3)._jdf.queryExecution().toString()
    assert "segments" not in plan and "text" not in plan.replace("Text", "").split("Physical Plan")[-1].lower().replace("text_index", "")
    assert index.search("zzz", 3).count() == 0 and index.search("", 3).count() == 0


@pytest.mark.parametrize("any_of, least", [({"severity": ["High"]}, 7.0), ({"severity": []}, 3.0), ({"severity": ["Low", "High"]}, None), ({}, -1.0), ({"severity": ["none"]}, None)])
def test_a_selection_is_fitted_by_itself(built, any_of, least):
    index, rows = built
    at_least = {} if least is None else {"score": least}
    kept = [r for r in rows if (not any_of.get("severity") or r[2] in any_of["severity"]) and (least is None or (r[3] or 0) >= least)]
    found = index.search_selection("w1 w2 w30", index.select(any_of, at_least), 20).collect()
    same([(r.doc, r.relevance) for r in found], plain_search("w1 w2 w30", [(r[0], r[1]) for r in kept])[:20])


def test_a_generation_keeps_its_tables_only(built):
    index, _ = built
    last = sorted((pathlib.Path(index.path) / "generations").iterdir())[-1]
    assert {p.name for p in last.iterdir() if not p.name.startswith(".")} == {"terms", "docs", "forward", "blocks", "bits", "size"}


def test_pairs_are_shuffled_in_rounds(spark, tmp_path, monkeypatch):
    """A commit deals the pairs of a share of the batches at a time; ids that repeat in no segment, texts without terms."""
    monkeypatch.setattr(text_index, "CELL_BITS", 2)
    monkeypatch.setattr(text_index, "ROUND_PARTITIONS", 2)
    rows = corpus(120, 3)
    index = SegmentedIndex(spark, str(tmp_path / "index"), ["severity", "score"], STOP)
    schema = "id string, text string, severity string, score double"
    for part in (rows[:50], rows[50:]):
        index.add(spark.createDataFrame(part, schema), "id", F.col("text"))
    index.commit()
    for name in ("forward", "blocks"):
        written = {p.name.split("-", 2)[2] for p in (tmp_path / "index/generations/00000000" / name).glob("part-*")}
        assert len(written) == 4
    wanted = plain_search("w1 w2 w30", [(r[0], r[1]) for r in rows])
    for top_k in (5, None):
        same([(r.doc, r.relevance) for r in index.search("w1 w2 w30", top_k).collect()], wanted[:top_k])
    numbers = [r.number for r in index.table("docs").collect()]
    assert len(numbers) == len(set(numbers)) == 120 and max(numbers) < 120 + 4 * 8
    terms = [(r.term, r.df) for r in index.table("terms").collect()]
    counted = Counter(t for r in rows for t in set(plain_terms(r[1])))
    assert sorted(terms) == sorted(counted.items())


def test_an_empty_index(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"), ["severity"], STOP)
    index.add(spark.createDataFrame([], "id string, text string, severity string"), "id", F.col("text"))
    index.commit()
    assert index.search("w1", 5).count() == 0
    assert index.search_selection("w1", index.select({"severity": ["High"]}), 5).count() == 0


def test_pairs_are_not_dealt_by_document_for_a_selection(built):
    """Documents are chosen by bits; the pairs of all others are neither joined nor shuffled."""
    index, _ = built
    found = index.search_selection("w1 w2", index.select({"severity": ["High"]}), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan
