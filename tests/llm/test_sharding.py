import zlib

from pyspark.sql import functions as F

from vulnspark.llm.sharding import ring_shards


def check(rows, shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by_shard.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_odd_rows(odd_docs):
    rows = ring_shards(odd_docs, 5, replicas=16).collect()
    check(rows, 5)
    expected = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == expected


def test_one_row_repeated(spark):
    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    check(ring_shards(docs, 40).collect(), 40)


def test_a_row_repeated_over_several_stretches(spark):
    docs = spark.range(30_000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("doc_id"), F.lit("same").alias("text"))
    rows = ring_shards(docs, 7, replicas=16).collect()
    check(rows, 7)
    assert len(rows) == 30_000


def test_more_shards_than_rows_and_no_rows(odd_docs, no_docs):
    check(ring_shards(odd_docs, 64, replicas=8).collect(), 64)
    assert ring_shards(no_docs, 4).collect() == []


def test_slack_moves_few_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    now = {r["doc_id"]: r["shard"] for r in ring_shards(docs, 10, slack=0.2).collect()}
    then = {r["doc_id"]: r["shard"] for r in ring_shards(docs, 11, slack=0.2).collect()}
    counts = [list(now.values()).count(s) for s in range(10)]
    assert max(counts) <= 480
    assert sum(now[i] != then[i] for i in now) < 0.25 * len(now)


def test_runs_without_python(odd_docs, capsys):
    ring_shards(odd_docs, 4).explain()
    assert "Python" not in capsys.readouterr().out
