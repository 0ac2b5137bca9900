"""Advisory pages to records."""

from pyspark.sql import functions as F

from vulnspark import schemas
from vulnspark.operators import pages as p
from vulnspark.plans import collect_records

FULL = """<!DOCTYPE html><html><head><title>t</title><style>p {}</style></head><body>
<h1 class="is-4 title"> CVE-2024-1 </h1><p class="lead">no</p><p class="mb-0"> A <b>title</b></p>
<p class="content">One &lt;two&gt; &amp; three<!-- hidden --></p><p class="content">second</p>
<time> 2024-01-05 </time><span><time>2024-02-01</time></span>
<div class="cve-y-scroll x"><div><ul><li> CWE-79: XSS</li><li>CWE-20: <i>Input</i></li></ul><ul><li>CWE-1: no</li></ul></div></div>
<nav id="other"><div class="level-item"><p class="cve-product-status-heading">Vendor</p><p>wrong</p></div></nav>
<nav id="cve-vendor-product-platforms">
 <div class="level-item"><p class="cve-product-status-heading">Vendor</p><p>first</p></div>
 <div class="level-item"><p class="cve-product-status-heading"> Vendor </p><span>-</span><p> acme </p><p>later</p></div>
 <div class="level-item"><p class="cve-product-status-heading">Product</p><p>box</p></div>
 <div class="level-item"><p class="cve-product-status-heading">Product</p></div>
 <div class="level-item"><p>Product</p><p>none</p></div></nav>
<ul><li>affected at 1.2<br></li><li>fixed</li><li> also affected at <b>2</b> </li></ul>
<table class="table cve-border-dark-blue"><thead><tr><td data-label="Score">head</td></tr></thead><tbody>
<tr><td data-label="Score"> 9.8 </td><td data-label="Severity">CRITICAL</td><td data-label="Version">3.1</td><td data-label="Vector String">AV:N</td></tr>
<tr><td data-label="Score">5</td><td data-label="Version">2.0</td></tr></tbody></table>
<table class="cve-border-dark-blue"><tbody><tr><td data-label="Score">1</td></tr></tbody></table>
</body></html>"""
BARE = "<h1>no class</h1><time>2024-01-01</time><li>affected at 3</li><table class='cve-border-dark-blue'></table>"


def records(spark, *sources, attack="SQL Injection"):
    df = spark.createDataFrame([(i, attack, s) for i, s in enumerate(sources)], "seq int, attack string, html string")
    return p.extract_records(df, order=["seq"]).orderBy("seq").collect()


def test_full_page(spark):
    row = records(spark, FULL)[0]
    assert (row.cve_id, row.title, row.description) == ("CVE-2024-1", "A title", "One <two> & three")
    assert (row.published_date, row.last_modified_date) == ("2024-01-05", "2024-02-01")
    assert row.cwe == ["CWE-79: XSS", "CWE-20: Input"]
    assert (row.vendor, row.product) == ("acme", "box")
    assert row.affected_versions == ["affected at 1.2", "also affected at 2"]
    assert [tuple(c) for c in row.cvss] == [("9.8", "CRITICAL", "3.1", "AV:N"), ("5", None, "2.0", None)]
    assert row.attackType == "SQL Injection"


def test_missing_parts(spark):
    row, empty, null = records(spark, BARE, "", None)
    assert (row.cve_id, row.title, row.vendor, row.product) == (None, None, None, None)
    assert (row.published_date, row.last_modified_date) == ("2024-01-01", None)
    assert (row.cwe, row.cvss, row.affected_versions) == ([], [], [])
    for r in (empty, null):
        assert r.cve_id is None and r.cvss == [] and r.affected_versions == []


def test_columns_are_those_of_a_record(spark):
    df = spark.createDataFrame([("x", FULL)], "attack string, html string")
    found = p.to_raw_columns(p.extract_records(df))
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in schemas.RAW_RECORD]


def test_unclosed_and_stray_tags(spark):
    html = "</div><div><p>a<p>b</div><p>c</p></span><li>x<li>y</ul>"
    row = p.list_elements(spark.createDataFrame([(html,)], "html string")).first()
    found = [(e.tag, row.page_text[e.start : e.stop], e.parent) for e in row.elements]
    assert found == [("div", "ab", -1), ("p", "ab", 0), ("p", "b", 1), ("p", "c", -1), ("li", "xy", -1), ("li", "y", 4)]


def test_nested_elements_do_not_repeat_their_text(spark):
    """8,000 unclosed items, each holding all that follow."""
    html = "".join(f"<li>item {i}" for i in range(8000))
    df = p.list_elements(spark.createDataFrame([(html,)], "html string"))
    batches = df.toArrow()
    assert batches.nbytes < 10 * len(html) and len(df.first().elements) == 8000
    found = p.extract_records(spark.createDataFrame([(html, "x")], "html string, attack string")).first()
    assert found.cve_id is None and found.affected_versions == []


def test_cap_tag_and_union(spark):
    pages = spark.createDataFrame(
        [(i, a, f"<h1 class='title'>{a}{i}</h1>") for a in ("x", "y") for i in range(5)],
        "seq int, attack string, html string")
    capped = p.collect_per_term(pages, limit=2)
    assert sorted((r.attack, r.seq) for r in capped.collect()) == [("x", 0), ("x", 1), ("y", 0), ("y", 1)]
    assert collect_records(pages).count() == 10
    ids = spark.createDataFrame([("A",), ("A",)], "cve_id string")
    assert [tuple(r) for r in p.tag_and_union({"t1": ids, "t2": ids.limit(1)}).orderBy("attackType").collect()] == [
        ("A", "t1"), ("A", "t1"), ("A", "t2")]


def test_links_and_text_block(spark):
    html = '<a class=x href="/CVERecord?id=1">a</a><a>no</a><a href="/other">b</a><a href="/CVERecord?id=2"></a>'
    df = spark.createDataFrame([(html, "A", None)], "html string, cve_id string, title string")
    assert [r.link for r in p.links(df).collect()] == ["/CVERecord?id=1", "/CVERecord?id=2"]
    odd = "<A HREF='/x?a=1&amp;b'>a</A><!-- <a href='/no'>--><a href=/y>b</a><a href>c</a><script>'<a href=\"/s\">'</script>"
    pages = spark.createDataFrame([(1, odd, "old"), (2, None, "old"), (3, "", "old")], "id int, html string, link string")
    assert [tuple(r) for r in p.links(pages, prefix="/").collect()] == [(1, "/x?a=1&b"), (1, "/y")]
    shown = df.select(p.record_text({"CVE ID": "cve_id", "Title": "title"}).alias("v")).first().v
    assert shown == "CVE ID       : A\nTitle        : None\n"


def test_a_page_the_parser_refuses_is_marked(spark):
    pages = spark.createDataFrame([(1, "<![foo[ x ]]><p>a</p>"), (2, "<p>a</p>")], "id long, html string")
    found = {r["id"]: [e["tag"] for e in r["elements"]] for r in p.list_elements(pages).collect()}
    assert p.REFUSED in found[1] and found[2] == ["p"]


def test_pages_are_capped_only_on_request(spark):
    pages = spark.createDataFrame([(i, "x") for i in range(700)], "seq long, attack string")
    assert p.collect_per_term(pages).count() == 700
