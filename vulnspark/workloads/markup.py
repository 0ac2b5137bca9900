"""Pages and robots texts."""

from pyspark.sql import functions as F

from vulnspark.functions.nested import first_or_null
from vulnspark.operators import pages as page_ops
from vulnspark.operators.stats import value_counts
from vulnspark.plans.advisories import collect_records
from vulnspark.sources.scan import spread
from vulnspark.sources.robots import disallowed_paths
from vulnspark.workloads import base
from vulnspark.workloads.base import slots, table, workload
from vulnspark.workloads.records import rating_texts


def _sql_tag(tag: str) -> str:
    return rf"regexp_extract_all(html, '<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>', 1)"


@workload(
    "page_fields",
    f"""SELECT page_id, {base.sql_strip(_sql_tag('h1') + '[1]')} AS heading, {base.sql_strip(_sql_tag('title') + '[1]')} AS title,
          {base.sql_strip(_sql_tag('p') + '[1]')} AS first_text, {base.sql_strip(_sql_tag('p') + '[2]')} AS second_text
        FROM pages""",
)
def page_fields(spark, sf_dir):
    html = F.col("html")
    paragraphs = page_ops.tag_texts(html, "p")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        first_or_null(page_ops.tag_texts(html, "h1")).alias("heading"),
        first_or_null(page_ops.tag_texts(html, "title")).alias("title"),
        first_or_null(paragraphs, 0).alias("first_text"),
        first_or_null(paragraphs, 1).alias("second_text"),
    )


@workload(
    "page_links",
    r"""SELECT page_id, link FROM (
          SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages)
        WHERE starts_with(link, '/')""",
)
def page_links(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), slots(spark))
    return page_ops.links(pages, prefix="/")


# Every way to write a link, and places where none is.
_LINK_FORMS = (
    "<A HREF='/one?p=", "&amp;q=1#&eacute;'>x</A><a class=b href=/two/", " rel=x>y</a><a title='>' href = \"/three\">z</a>"
    "<!-- <a href='/hidden'>x</a> --><script>var a = '<a href=\"/script\">';</script><a name=n>no</a><a href>none</a><a href='other'>o</a>",
)


@workload(
    "page_link_forms",
    r"""SELECT page_id, unnest(list_concat(
          list_filter(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), lambda x: starts_with(x, '/')),
          ['/one?p=' || page_id || '&q=1#é', '/two/' || page_id, '/three'])) AS link FROM pages""",
)
def page_link_forms(spark, sf_dir):
    """The links of every page with more of them appended, written in every way."""
    first, second, third = (F.lit(x) for x in _LINK_FORMS)
    number = F.col("page_id").cast("string")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", first, number, second, number, third).alias("html"))
    return page_ops.links(spread(pages, slots(spark)), prefix="/")


@workload(
    "page_list_items",
    f"""SELECT page_id, array_to_string(list_transform(items, lambda x: {base.sql_strip('x')}), '|') AS items,
          CAST(len(items) AS INTEGER) AS n, CAST(len(list_filter(items, lambda x: contains(x, 'th'))) AS INTEGER) AS with_th
        FROM (SELECT page_id, {_sql_tag('li')} AS items FROM pages)""",
)
def page_list_items(spark, sf_dir):
    items = table(spark, sf_dir, "pages").select(
        "page_id", page_ops.tag_texts(F.col("html"), "li").alias("i")
    )
    with_th = F.filter("i", lambda x: F.contains(x, F.lit("th")))
    return items.select(
        "page_id", F.array_join("i", "|").alias("items"), F.size("i").alias("n"),
        F.size(with_th).alias("with_th"),
    )


@workload(
    "page_elements",
    r"""SELECT page_id, CAST(len(regexp_extract_all(body, '<h1[\s>]')) AS INTEGER) AS headings,
          CAST(len(regexp_extract_all(body, '<nav[\s>]')) AS INTEGER) AS navs,
          CAST(len(regexp_extract_all(body, '<li[\s>]')) AS INTEGER) AS items
        FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
                '<script[^>]*>.*?</script>', '', 'gs') AS body FROM pages)""",
)
def page_elements(spark, sf_dir):
    """The parsed element list of the stored pages, counted by tag."""
    parsed = page_ops.list_elements(
        spread(table(spark, sf_dir, "pages").select("page_id", "html"), slots(spark)),
        tags=("h1", "nav", "li"),
    )

    def count(tag):
        return F.size(F.filter("elements", lambda e: e["tag"] == tag))

    return parsed.select(
        "page_id", count("h1").alias("headings"), count("nav").alias("navs"), count("li").alias("items")
    )


def _escape(c):
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def advisory_pages(spark, sf_dir):
    """One advisory page per document, with the markup of stored advisory pages."""
    d = F.col("doc_id")
    rating = F.concat(
        F.lit('<tr><td data-label="Score"> '), F.floor(d % 101 / 10).cast("string"), F.lit("."),
        (d % 101 % 10).cast("string"), F.lit("</td>"),
        F.when(d % 4 == 0, "").otherwise('<td data-label="Severity">HIGH</td>'),
        F.lit('<td data-label="Version">3.1</td><td data-label="Vector String">AV:N</td></tr>'),
    )
    table_markup = F.when(d % 5 == 0, "").otherwise(F.concat(
        F.lit('<table class="table cve-border-dark-blue"><thead><tr><th>Score</th></tr></thead><tbody>'),
        rating, rating, F.lit("</tbody></table>")))

    def pair(key, value):
        return F.concat(
            F.lit(f'<div class="level-item"><p class="cve-product-status-heading">{key}</p><p>\n '),
            value, F.lit(" </p></div>"))

    status = F.when(d % 6 == 0, "").otherwise(F.concat(
        F.lit('<nav id="cve-vendor-product-platforms" class="level">'),
        pair("Vendor", F.lit("first")), pair("Vendor", F.col("source")), pair("Product", F.col("lang")),
        F.lit("</nav>")))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>x</title><script>var p = '<p class=\"content\">';</script></head><body>"),
        F.lit('<h1 class="is-4 title"> CVE-'), d.cast("string"), F.lit('</h1><p class="mb-0">'),
        _escape(F.substring_index("text", ".", 1)), F.lit('</p><p class="content">'), _escape(F.col("text")),
        F.lit("</p><time>2024-01-0"), (d % 9 + 1).cast("string"), F.lit("</time>"),
        F.when(d % 3 == 0, "").otherwise("<time>2024-02-01</time>"),
        F.lit('<div class="cve-y-scroll"><ul><li> CWE-79: Cross </li><li>CWE-'), (d % 50).cast("string"),
        F.lit(": <b>bold</b> name</li></ul></div>"), status,
        F.lit("<ul><li> affected at 1."), (d % 7).cast("string"), F.lit("<br></li><li>fixed</li></ul>"),
        table_markup, F.lit("</body></html>"),
    )
    attack = F.get(F.array(*[F.lit(a) for a in page_ops.ATTACK_TERMS]), (d % 4).cast("int"))
    return spread(table(spark, sf_dir, "documents"), slots(spark)).select(d.alias("seq"), attack.alias("attack"), html.alias("html"))


_RECORD_SQL = f"""
    SELECT doc_id AS seq, 'CVE-' || doc_id AS cve_id, {base.sql_strip("split_part(text, '.', 1)")} AS title,
      {base.sql_strip('text')} AS description, '2024-01-0' || (doc_id % 9 + 1) AS published_date,
      CASE WHEN doc_id % 3 <> 0 THEN '2024-02-01' END AS last_modified_date,
      'CWE-79: Cross|CWE-' || (doc_id % 50) || ': bold name' AS cwe,
      CASE WHEN doc_id % 5 = 0 THEN '' ELSE r || ';' || r END AS cvss,
      CASE WHEN doc_id % 6 <> 0 THEN trim(source) END AS vendor, CASE WHEN doc_id % 6 <> 0 THEN trim(lang) END AS product,
      CASE WHEN doc_id % 6 <> 0 THEN 'affected at 1.' || (doc_id % 7) ELSE '' END AS affected_versions,
      ['Prompt Injection', 'SQL Injection', 'Cross-Site Scripting', 'Buffer Overflow'][(doc_id % 4) + 1] AS "attackType"
    FROM (SELECT *, (doc_id % 101 // 10) || '.' || (doc_id % 101 % 10) || '/' ||
            CASE WHEN doc_id % 4 = 0 THEN '~' ELSE 'HIGH' END || '/3.1/AV:N' AS r FROM documents)
"""


def _shown(records):
    return records.select(
        "seq", "cve_id", "title", "description", "published_date", "last_modified_date",
        F.array_join("cwe", "|").alias("cwe"), rating_texts(F.col("cvss")).alias("cvss"), "vendor", "product",
        F.array_join("affected_versions", "|").alias("affected_versions"), "attackType",
    )


@workload("page_records", _RECORD_SQL)
def page_records(spark, sf_dir):
    """Every advisory page to its record."""
    return _shown(page_ops.extract_records(advisory_pages(spark, sf_dir), order=["seq"]))


@workload(
    "collected_records",
    f"""SELECT * EXCLUDE (rank) FROM (
          SELECT *, row_number() OVER (PARTITION BY "attackType" ORDER BY seq) AS rank FROM ({_RECORD_SQL}))
        WHERE rank <= 100""",
)
def collected_records(spark, sf_dir):
    """At most 100 pages per search term, parsed and tagged."""
    return _shown(collect_records(advisory_pages(spark, sf_dir), limit=100))


@workload("all_collected_records", _RECORD_SQL)
def all_collected_records(spark, sf_dir):
    """Every page of every search term, as it is without a limit."""
    return _shown(collect_records(advisory_pages(spark, sf_dir)))


@workload(
    "records_per_term",
    f'SELECT "attackType", count(*) AS n FROM ({_RECORD_SQL}) GROUP BY 1',
)
def records_per_term(spark, sf_dir):
    terms = advisory_pages(spark, sf_dir).select(F.col("attack").alias("attackType"))
    return value_counts(terms, "attackType")


_LIST_SQL = "CASE WHEN {0} = '' THEN '[]' ELSE '[' || replace({0}, '|', ', ') || ']' END"


@workload(
    "record_text",
    f"""SELECT seq, 'CVE ID       : ' || cve_id || chr(10) || 'Title        : ' || title || chr(10) ||
          'Description  : ' || description || chr(10) || 'Published    : ' || published_date || chr(10) ||
          'Modified     : ' || coalesce(last_modified_date, 'None') || chr(10) ||
          'CWE          : ' || {_LIST_SQL.format("cwe")} || chr(10) ||
          'CVSS         : ' || CASE WHEN cvss = '' THEN '[]' ELSE '[' || rating || ', ' || rating || ']' END || chr(10) ||
          'Vendor       : ' || coalesce(vendor, 'None') || chr(10) || 'Product      : ' || coalesce(product, 'None') || chr(10) ||
          'Affected     : ' || {_LIST_SQL.format("affected_versions")} || chr(10) ||
          'Attack Type  : ' || "attackType" || chr(10) AS shown
        FROM (SELECT *, '{{' || (seq % 101 // 10) || '.' || (seq % 101 % 10) || ', ' ||
                CASE WHEN seq % 4 = 0 THEN 'null' ELSE 'HIGH' END || ', 3.1, AV:N}}' AS rating FROM ({_RECORD_SQL}))""",
)
def record_text(spark, sf_dir):
    """Every record as it is printed, under all eleven labels."""
    records = page_ops.extract_records(advisory_pages(spark, sf_dir), order=["seq"])
    return records.select("seq", page_ops.record_text(page_ops.RECORD_LABELS).alias("shown"))


@workload(
    "robots_disallow",
    r"""SELECT page_id, trim(substr(line, 10)) AS path FROM (
          SELECT page_id, unnest(string_split(
            'User-agent: *' || chr(10) || 'Disallow: ' || regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) || ' ' || chr(10) ||
            ' Disallow: /no' || chr(10) || 'Allow: /' || chr(10) || 'Disallow:', chr(10))) AS line FROM pages)
        WHERE starts_with(line, 'Disallow:')""",
)
def robots_disallow(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    robots = F.concat(
        F.lit("User-agent: *\nDisallow: "), path, F.lit(" \n Disallow: /no\nAllow: /\nDisallow:")
    )
    lines = table(spark, sf_dir, "pages").select(
        "page_id", F.explode(F.split(robots, "\n")).alias("value")
    )
    return disallowed_paths(lines)
