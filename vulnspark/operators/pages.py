"""Records from stored advisory pages.

Markup is the one thing the built-in functions cannot parse. A small Python step
turns each page into its text, once, and the list of its elements, each with the stretch of
the text it holds; so the result stays in proportion to the page, however deep elements
are nested. Everything after it (choice by tag, class and place, cutting out text, trimming,
defaults) is built-in expressions. Simple pulls from simple markup (``tag_texts``) need no
Python at all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark import schemas
from vulnspark.functions.nested import first_or_null, or_no_items
from vulnspark.functions.text import strip
from vulnspark.operators.dedup import cap_per_group

# The search terms advisories are collected under, and the limits
# on what is collected per term.
ATTACK_TERMS = ("Prompt Injection", "SQL Injection", "Cross-Site Scripting", "Buffer Overflow")
ROWS_PER_RESULT_PAGE = 200
RESULT_PAGES = 3
RECORD_LINK = "/CVERecord?id="

# The labels of a printed record and the columns behind them.
RECORD_LABELS = {
    "CVE ID": "cve_id",
    "Title": "title",
    "Description": "description",
    "Published": "published_date",
    "Modified": "last_modified_date",
    "CWE": "cwe",
    "CVSS": "cvss",
    "Vendor": "vendor",
    "Product": "product",
    "Affected": "affected_versions",
    "Attack Type": "attackType",
}

# Elements a record is built from.
RECORD_TAGS = ("h1", "p", "time", "div", "ul", "li", "nav", "table", "tbody", "tr", "td")

# ``start`` and ``stop`` bound the element's text within the text of the page.
ELEMENTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("at", T.IntegerType()),
            T.StructField("last", T.IntegerType()),
            T.StructField("parent", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
            T.StructField("tag", T.StringType()),
            T.StructField("id", T.StringType()),
            T.StructField("classes", T.ArrayType(T.StringType())),
            T.StructField("label", T.StringType()),
            T.StructField("href", T.StringType()),
        ]
    )
)
TEXT = "page_text"

# Tag of the element that marks a page the parser could not read to its end.
REFUSED = "#refused"

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NO_TEXT = frozenset(("script", "style", "template"))

# What a step gathers before it hands on a batch: bytes of text, and elements of some 100 bytes.
_BATCH_TEXT, _BATCH_ELEMENTS = 4 << 20, 40_000


class _ElementLister(HTMLParser):
    """Lists elements in document order with the extent of their content."""

    def __init__(self, tags: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.tags = frozenset(tags)

    def read(self, html: str) -> tuple[str, list[list]]:
        """The text of a page and its elements, as values in the order of ``ELEMENTS``."""
        self.reset()
        self.count, self.open, self.found, self.texts, self.length, self.names = 0, [], [], [], 0, Counter()
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError):
            # Markup the parser refuses: the page is listed as far as it came, marked by an element of its own.
            self.found.append([self.count, self.count, -1, self.length, self.length, REFUSED, None, [], None, None])
            self.count += 1
        while self.open:
            self._close_one()
        self.found.sort(key=lambda e: e[0])
        return "".join(self.texts), self.found

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        parent = self.open[-1][0] if self.open else -1
        classes = (attrs.get("class") or "").split()
        self.open.append(
            [self.count, self.count, parent, self.length, self.length, tag, attrs.get("id"), classes, attrs.get("data-label"), attrs.get("href")]
        )
        self.names[tag] += 1
        self.count += 1
        if tag in _VOID:
            self._close_one()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close_one()

    def handle_endtag(self, tag):
        if self.names[tag]:
            while self._close_one() != tag:
                pass

    def handle_data(self, data):
        if not (self.open and self.open[-1][5] in _NO_TEXT):
            self.texts.append(data)
            self.length += len(data)

    def _close_one(self) -> str:
        element = self.open.pop()
        element[1], element[4], tag = self.count - 1, self.length, element[5]
        self.names[tag] -= 1
        if tag in self.tags:
            self.found.append(element)
        return tag


def _element_array(pages: list[list[list] | None]) -> pa.Array:
    """The lists of a batch as one Arrow array, column by column."""
    kinds = [pa.int32()] * 5 + [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
    columns = zip(*(e for page in pages for e in page or ())) if any(pages) else ((),) * len(kinds)
    fields = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ELEMENTS.elementType.names)
    ends = [0]
    for page in pages:
        ends.append(ends[-1] + len(page or ()))
    nulls = pa.array([page is None for page in pages] + [False])
    offsets = pa.array(ends, pa.int32())
    return pa.ListArray.from_arrays(pc.if_else(nulls, pa.scalar(None, pa.int32()), offsets), fields)


def list_elements(
    pages: DataFrame, html: str = "html", tags: Sequence[str] = RECORD_TAGS, output: str = "elements", text: str = TEXT
) -> DataFrame:
    """Replace the page source by the list of its elements and its text."""
    kept = [f for f in pages.schema.fields if f.name != html]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(output, ELEMENTS), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _ElementLister(tags)

        def handed(batch, first, elements, texts):
            columns = [batch.column(batch.schema.get_field_index(n)).slice(first, len(texts)) for n in names]
            made = [_element_array(elements), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *made], [*names, output, text])

        for batch in batches:
            sources = batch.column(batch.schema.get_field_index(html))
            first, elements, texts, size, many = 0, [], [], 0, 0
            for i, source in enumerate(sources):
                page = source.as_py()
                found, listed = (None, None) if page is None else parser.read(page)
                texts.append(found)
                elements.append(listed)
                size, many = size + len(found or ""), many + len(listed or ())
                if size > _BATCH_TEXT or many > _BATCH_ELEMENTS:
                    yield handed(batch, first, elements, texts)
                    first, elements, texts, size, many = i + 1, [], [], 0, 0
            if texts or not batch.num_rows:
                yield handed(batch, first, elements, texts)

    return pages.select(*names, html).mapInArrow(run, schema)


# -- choosing elements ----------------------------------------------------------


def _having(elements: Column, tag: str, css_class=None, element_id=None, label=None) -> Column:
    def matches(e: Column) -> Column:
        hit = e["tag"] == tag
        if css_class is not None:
            hit = hit & F.array_contains(e["classes"], css_class)
        if element_id is not None:
            hit = hit & (e["id"] == element_id)
        if label is not None:
            hit = hit & (e["label"] == label)
        return hit

    return F.filter(elements, matches)


def _inside(elements: Column, outer: Column) -> Column:
    return F.filter(elements, lambda e: (e["at"] > outer["at"]) & (e["at"] <= outer["last"]))


def element_text(element: Column, text: str = TEXT) -> Column:
    """The text an element holds, untrimmed."""
    return F.substring(F.col(text), element["start"] + 1, element["stop"] - element["start"])


def _text(element: Column) -> Column:
    return strip(element_text(element))


def _platforms(df: DataFrame) -> DataFrame:
    """``status``: (vendor, product) from the heading/value pairs of the platforms
    box; null without the box, the last pair wins."""
    c = F.col
    df = df.withColumn(
        "_box", first_or_null(_having(c("elements"), "nav", element_id="cve-vendor-product-platforms"))
    )
    df = df.withColumn("_inner", _inside(c("elements"), c("_box")))
    df = df.withColumns(
        {
            "_items": _having(c("_inner"), "div", css_class="level-item"),
            "_heads": _having(c("_inner"), "p", css_class="cve-product-status-heading"),
            "_values": _having(c("_inner"), "p"),
        }
    )
    df = df.withColumn(
        "_heads", F.transform("_items", lambda item: first_or_null(_inside(c("_heads"), item)))
    )

    def pair(head: Column) -> Column:
        later = F.filter(
            "_values", lambda e: (e["parent"] == head["parent"]) & (e["at"] > head["at"])
        )
        return F.struct(
            _text(head).alias("key"), _text(first_or_null(later)).alias("value")
        )

    df = df.withColumn("_pairs", F.transform("_heads", pair))

    def last_of(key: str) -> Column:
        named = F.filter("_pairs", lambda p: (p["key"] == key) & p["value"].isNotNull())
        return F.try_element_at(named, F.lit(-1))["value"]

    status = F.struct(last_of("Vendor").alias("vendor"), last_of("Product").alias("product"))
    return df.withColumn("status", F.when(c("_box").isNotNull(), status))


def _ratings(df: DataFrame) -> DataFrame:
    """``cvss``: one struct per body row of the ratings table; a missing cell is null."""
    c = F.col
    df = df.withColumn(
        "_box", first_or_null(_having(c("elements"), "table", css_class="cve-border-dark-blue"))
    )
    df = df.withColumn("_inner", _inside(c("elements"), c("_box")))
    df = df.withColumn("_body", first_or_null(_having(c("_inner"), "tbody")))
    df = df.withColumn("_inner", _inside(c("_inner"), c("_body")))
    df = df.withColumns(
        {
            "_rows": _having(c("_inner"), "tr"),
            "_cells": F.filter("_inner", lambda e: (e["tag"] == "td") & e["label"].isNotNull()),
        }
    )

    def cell(row: Column, label: str) -> Column:
        hits = F.filter(
            "_cells",
            lambda e: (e["at"] > row["at"]) & (e["at"] <= row["last"]) & (e["label"] == label),
        )
        return _text(first_or_null(hits))

    rating = F.transform(
        "_rows",
        lambda row: F.struct(
            cell(row, "Score").alias("score"),
            cell(row, "Severity").alias("severity"),
            cell(row, "Version").alias("version"),
            cell(row, "Vector String").alias("vector"),
        ),
    )
    empty = "struct<score:string,severity:string,version:string,vector:string>"
    return df.withColumn("cvss", or_no_items(rating, empty))


def _weaknesses(df: DataFrame) -> DataFrame:
    """``cwe``: the items of the first list in the weakness box."""
    c = F.col
    df = df.withColumn("_box", first_or_null(_having(c("elements"), "div", css_class="cve-y-scroll")))
    df = df.withColumn("_list", first_or_null(_having(_inside(c("elements"), c("_box")), "ul")))
    items = F.filter(
        "elements",
        lambda e: (e["tag"] == "li") & (e["at"] > c("_list.at")) & (e["at"] <= c("_list.last")),
    )
    return df.withColumn("cwe", or_no_items(F.transform(items, _text)))


def affected_versions(elements: Column) -> Column:
    """The texts of the items that say so. Only these texts are built; items within items each have theirs."""
    items = F.filter(_having(elements, "li"), lambda e: F.contains(element_text(e), F.lit("affected at")))
    return F.transform(items, _text)


def extract_records(
    pages: DataFrame, html: str = "html", attack: str | None = "attack", order: Sequence[str] = ()
) -> DataFrame:
    """Stored pages to raw records, tagged with the search term they came from.

    The lists are built in steps of their own columns: an expression used inside a
    lambda would be evaluated for every element.
    """
    names = [*dict.fromkeys([*order, *([attack] if attack else [])])]
    parsed = list_elements(pages.select(*names, html), html)
    parsed = _weaknesses(_ratings(_platforms(parsed)))
    e = F.col("elements")
    times = _having(e, "time")
    return parsed.select(
        *[F.col(c) for c in order],
        _text(first_or_null(_having(e, "h1", css_class="title"))).alias("cve_id"),
        _text(first_or_null(_having(e, "p", css_class="mb-0"))).alias("title"),
        _text(first_or_null(_having(e, "p", css_class="content"))).alias("description"),
        _text(first_or_null(times, 0)).alias("published_date"),
        _text(first_or_null(times, 1)).alias("last_modified_date"),
        "cwe",
        "cvss",
        F.col("status.vendor").alias("vendor"),
        F.col("status.product").alias("product"),
        or_no_items(F.when(F.col("status").isNotNull(), affected_versions(e))).alias(
            "affected_versions"
        ),
        (F.col(attack) if attack else F.lit(None).cast("string")).alias("attackType"),
    )


def collect_per_term(
    pages: DataFrame, attack: str = "attack", order: Sequence[str] = ("seq",),
    limit: int | None = None,
) -> DataFrame:
    """All pages, or at most ``limit`` per search term, in order.

    ``ROWS_PER_RESULT_PAGE * RESULT_PAGES`` is what a search of the site shows.
    """
    if limit is None:
        return pages
    return cap_per_group(pages, [attack], order, limit)


def tag_and_union(parts: dict[str, DataFrame], tag: str = "attackType") -> DataFrame:
    """All rows of all parts, each tagged with the name of its part."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def record_text(record_columns: dict[str, str]) -> Column:
    """One labelled line per entry (label -> column), as a record is printed."""
    lines = [
        F.concat(F.lit(f"{label:<13}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")),
                 F.lit("\n"))
        for label, c in record_columns.items()
    ]
    return F.concat(*lines)


def to_raw_columns(df: DataFrame, *beside: str) -> DataFrame:
    return df.select(*beside, *schemas.RAW_RECORD.fieldNames())


# -- pulls without Python -------------------------------------------------------


def tag_texts(html: Column, tag: str) -> Column:
    """Trimmed inner text of every ``tag`` element that holds no further markup."""
    pattern = rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>"
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), strip)


# -- links ------------------------------------------------------------------------


def links(pages: DataFrame, html: str = "html", prefix: str = RECORD_LINK, output: str = "link") -> DataFrame:
    """One row per anchor whose target starts with a prefix, in document order within a page.

    However the attribute is written: in single quotes, without quotes, in capitals. Character
    references are resolved; anchors in comments, scripts and styles are none.
    """
    kept = [c for c in pages.columns if c not in (html, output)]
    anchors = list_elements(pages.select(*kept, html), html, tags=("a",))
    targets = F.transform("elements", lambda e: e.getField("href"))
    return anchors.select(*kept, F.explode(F.filter(targets, lambda x: F.startswith(x, F.lit(prefix)))).alias(output))
