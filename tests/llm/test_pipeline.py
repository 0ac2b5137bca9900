import os
import random
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline
from vulnspark.llm.queries import tokenizer_path
from vulnspark.llm.registry import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def sf_dir(spark, odd_docs, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    odd_docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    text = " ".join(odd_docs.filter("doc_id = 10").first()["text"].split()[50:80])
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, odd_docs, sf_dir, tmp_path):
    docs = odd_docs
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.dtypes == odd_docs.dtypes
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2] == counts[3]
    left = docs.collect()
    # One of each group of copies stays, with no id too, and all the rest.
    assert len([r for r in left if r["doc_id"] in (6, 7)]) == 1
    texts = [r["text"] for r in left if r["text"]]
    assert len(texts) == len(set(texts))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    assert not any(bench[:60] in t for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.selectExpr("count(DISTINCT doc_id, piece)", "max(length)").first()[1] <= 4096
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_near_dedup_against_brute_force(spark, odd_docs, sf_dir):
    """One document per component of fingerprints that link, the first by id, null ids last."""
    from vulnspark.llm.simhash import fingerprints

    rows = [(r["doc_id"], r["text"], r["fp"] % (1 << 64)) for r in fingerprints(odd_docs, ["doc_id", "text"], "text", 3).collect()]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][2] ^ rows[j][2]).bit_count() <= 2:
                root[find(i)] = find(j)
    parts = {}
    for i, (d, t, _) in enumerate(rows):
        parts.setdefault(find(i), []).append((d is None, d or 0))
    wanted = sorted(min(p) for p in parts.values())
    kept = corpus_pipeline.simhash_near_dedup(spark, odd_docs, sf_dir).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == wanted


def test_repeated_passages_of_51_words(spark, sf_dir):
    """A passage of over 50 words goes from every document that holds it, though it has less than 400 bytes."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))
    passage = prose(51)
    assert len(passage) < 400
    rows = [(i, f"{prose(80)} {passage} {prose(60)}") for i in range(3)] + [(i, prose(140)) for i in range(3, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_array_dedup(spark, docs, sf_dir).collect()}
    for i, text in rows:
        left = [part.strip() for part in text.split(passage)]
        assert passage not in found[i] and [found[i][: len(left[0])], found[i][len(found[i]) - len(left[-1]) :]] == [left[0], left[-1]]
        assert len(found[i]) <= sum(map(len, left)) + 2


def test_no_documents(spark, no_docs, sf_dir, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).collect() == []


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert os.path.exists(tokenizer_path())


def test_the_rest_works_without_the_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 70


def test_workers_need_no_package(spark, odd_docs, tmp_path):
    """A driver that finds the package by itself; its workers do not."""
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "the " * 12)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from vulnspark.session import local_session
import vulnspark.llm.queries
from vulnspark.llm.registry import QUERIES
spark = local_session(2)
def bare(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("vulnspark") is None
        yield b
spark.range(1).mapInArrow(bare, "id long").collect()
for name in ("op1_pitman_yor", "op4_decontamination", "op10_toxicity"):
    print(QUERIES[name].run(spark, {str(tmp_path)!r}).count())
"""
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere" / "driver.py").write_text(code)
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "driver.py"], cwd=tmp_path / "elsewhere", env=clean, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-3000:]
    assert out.stdout.split()[-3:] == [str(odd_docs.count())] * 3
