import re

import pytest
from pyspark.sql import functions as F

from vulnspark.llm.queries import URL_RULES
from vulnspark.llm.url_filter import Settings, judge_urls


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def rule(host, path):
    best = None
    for text, says in URL_RULES:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or len(text) > len(best[0]):
                best = text, says
    return best


ODD = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://A.NET/En/1", "http://a.example.net/en/x?u=http://b.com/de/", "http://net", "http://net/",
    "http://example.com/de/9#x", "http://xexample.com/de/9", "http://É.Org/fr/", "x://y.org/fr?z", "http://b.org/" + "a/" * 3000, "http://b.org//fr/",
    "http://c.com/a b/\n/z", "http://a.example.com/de/", "http://a.example.com/de/",
]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "p")
    rows = [(i if i % 5 else None, u, "clash", "clash") for i, u in enumerate(ODD)]
    spark.createDataFrame(rows, "page_id long, url string, host string, template string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_rules_and_parts(pages):
    rows = judge_urls(pages, URL_RULES).collect()
    assert len(rows) == len(ODD)
    expected = []
    for url in ODD:
        host, path = parsed(url)
        best = rule(host, path)
        expected.append((host, path, best and best[0]))
    assert sorted((r["host"], r["path"], r["rule"] or "") for r in rows) == sorted((h, p, x or "") for h, p, x in expected)
    says = dict(URL_RULES)
    assert all(r["verdict"] == says[r["rule"]] for r in rows if r["rule"])
    assert judge_urls(pages.limit(0), URL_RULES).collect() == []


def found(spark, urls, **settings):
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [("h.com/bad/", "block")], settings=Settings(**settings))
    return {r["page_id"]: r for r in rows.collect()}


def test_variable_segments_become_wildcards(spark):
    urls = [f"http://h.com/item/{i}/view" for i in range(50)] + [f"http://h.com/list/{i}" for i in range(50)]
    rows = found(spark, urls)
    assert {rows[i]["template"] for i in range(50)} == {"/item/*/view"}
    assert {rows[i]["template"] for i in range(50, 100)} == {"/list/*"}


def test_like_branches_merge_and_others_do_not(spark):
    urls = [f"http://h.com/{s}/{i}" for s in ("red", "blue", "green") for i in range(40)] + [f"http://h.com/blog/post/{i}/x" for i in range(200)]
    rows = found(spark, urls, likeness=0.7)
    assert {rows[i]["template"] for i in range(120, 320)} == {"/blog/post/*/x"} or {rows[i]["template"] for i in range(120)} == {"/*/*"}
    labelled = [f"http://h.com/{s}/{i}" for s in ("bad", "good") for i in range(60)]
    rows = found(spark, labelled)
    assert {rows[i]["template"] for i in range(60)} == {"/bad/*"} and {rows[i]["template"] for i in range(60, 120)} == {"/good/*"}
    assert {rows[i]["verdict"] for i in range(60, 120)} == {"allow"}


def test_pure_templates_are_rejected(spark):
    urls = [f"http://h.com/bad/{i}" for i in range(7)] + [f"http://h.com/x{i}/{i}" for i in range(3)]
    rows = found(spark, urls, support=100)
    assert {r["template"] for r in rows.values()} == {"/*/*"}
    assert {r["verdict"] for r in rows.values()} == {"block"}
    assert {found(spark, urls, support=100, coverage=0.9)[i]["verdict"] for i in (7, 8, 9)} == {"allow"}


def test_one_url_for_all(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("http://one.net/a/1").alias("url"))
    assert judge_urls(pages, URL_RULES).groupBy("verdict", "template").count().collect()[0]["count"] == 2000
