"""XML files of flat repeated elements, read record by record.

The built-in XML source hands a whole file to one task. Here the text source
cuts the files before every row's opening tag instead, so one large file is read
by many tasks, a malformed record does not take its neighbours along, and a file
in the wrong encoding can be decoded on the way.

Whether such a tag opens a record depends on all text before it: it may lie in a
comment, a CDATA section or a processing instruction, or belong to a longer name. Each piece
of text therefore yields its transition, from every state the lexer may be in at its start
to the state at its end. Transitions compose: first over runs of pieces within a split, then
over the runs of a file, and the state at every place is known without reading a file
in order. Pieces that open no record go to the record before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.operators.computed import where_computed
from vulnspark.sources.ordering import DOC_ORDER, file_order

CORRUPT = "_corrupt_record"
_PATH, _BLOCK, _ROW = "_xml_path", "_xml_block", "_xml_row"
_SPLIT, _PIECE = [_PATH, _BLOCK], [_PATH, _BLOCK, _ROW]

# States of the lexer: outside, and within constructs that hide tags: how they open and close.
_OUTSIDE = "0"
_HIDING = {"1": ("<!--", "-->"), "2": ("<![CDATA[", "]]>"), "3": ("<?", "?>")}
_STATES = _OUTSIDE + "".join(_HIDING)
_WHOLE = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"
_OPENING = r"<!--|<!\[CDATA\[|<\?"

# Pieces that are followed one after the other in one step: 2^14 of them, some MB of text.
_RUN_BITS = 14


def undecodable_files(spark: SparkSession, path) -> DataFrame:
    """(file) that holds a line which is not UTF-8."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid")
    )
    return lines.groupBy("file").agg(F.bool_and("valid").alias("valid")).where(~F.col("valid")).select("file")


def _decoded(pieces: DataFrame, spark: SparkSession, path, encoding: str) -> DataFrame:
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    if encoding == "latin-1":
        return pieces.withColumn("value", latin)
    if encoding == "auto":
        bad = undecodable_files(spark, path).select(F.col("file").alias(_PATH), F.lit(True).alias("_latin"))
        mixed = pieces.join(bad, _PATH, "left")
        return mixed.withColumn("value", F.when(F.col("_latin"), latin).otherwise(F.col("value"))).drop("_latin")
    return pieces


# -- the lexer --------------------------------------------------------------------


def _end_outside(text: Column) -> Column:
    """The state at the end of a text that begins outside: what its first unclosed construct is."""
    left = F.regexp_extract(F.regexp_replace(text, f"(?s){_WHOLE}", ""), _OPENING, 0)
    end = F.when(left == "", _OUTSIDE)
    for state, (opening, _) in _HIDING.items():
        end = end.when(left == opening, state)
    return end


def transition(text: Column) -> Column:
    """The end states for each start state, one character each: "0123" changes nothing."""
    ends = [_end_outside(text)]
    for state, (_, closing) in _HIDING.items():
        at = F.instr(text, closing)
        rest = F.substr(text, at + len(closing))
        ends.append(F.when(at == 0, state).otherwise(_end_outside(rest)))
    marked = F.lit(False)
    for mark in ("<!", "<?", *(closing for _, closing in _HIDING.values())):
        marked = marked | F.contains(text, F.lit(mark))
    return F.when(marked, F.concat(*ends)).otherwise(_STATES)


def _after(state: Column, step: Column) -> Column:
    return F.substr(step, state.cast("int") + 1, F.lit(1))


def _runs(pieces: DataFrame) -> DataFrame:
    """Per run of pieces in a split: their (row, step, real) in order, and for each start state how the run ends.

    How it ends: the state, and the row of the last piece that opens a record. That is the composition
    of the run's steps. Only places and transitions are shuffled, no text.
    """
    steps = pieces.select(
        *_SPLIT, F.shiftright(_ROW, _RUN_BITS).alias("run"), F.struct(_ROW, transition(F.col("value")).alias("step"), "real").alias("piece")
    )
    runs = steps.groupBy(*_SPLIT, "run").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    no_row = F.lit(None).cast("long")

    def end(state, row) -> Column:
        return F.struct(state.alias("state"), row.alias("last"))

    def follow(done, p):
        opens = p["real"] & (done["state"] == _OUTSIDE)
        return end(_after(done["state"], p["step"]), F.when(opens, p[_ROW]).otherwise(done["last"]))

    states = F.array(*(F.lit(x) for x in _STATES))
    followed = F.transform(states, lambda x: F.aggregate("pieces", end(x, no_row), follow))
    last = F.array_max(F.transform(F.filter("pieces", lambda p: p["real"]), lambda p: p[_ROW]))
    calm = F.array(end(F.lit(_OUTSIDE), last), *(end(F.lit(x), no_row) for x in _HIDING))
    marked = F.exists("pieces", lambda p: p["step"] != _STATES)
    return runs.withColumn("marked", marked).withColumn("ends", F.when(F.col("marked"), followed).otherwise(calm))


def _begins(runs: DataFrame) -> DataFrame:
    """Per run: the state in which it ``begins``, and the piece (block, row) whose record goes on there, if any.

    A file begins outside, and its runs follow each other. The runs of a file, one for
    some MB of text, are followed in one task.
    """
    listed = F.array_sort(F.collect_list(F.struct(_BLOCK, "run", "ends")))
    files = runs.select(*_SPLIT, "run", "ends").groupBy(_PATH).agg(listed.alias("runs"))
    place = "struct<state:string,open:struct<block:bigint,row:bigint>>"
    start = F.struct(F.lit(_OUTSIDE).alias("state"), F.lit(None).cast("struct<block:bigint,row:bigint>").alias("open"))

    def follow(done, r):
        now = done["now"]
        end = F.get(r["ends"], now["state"].cast("int"))
        opened = F.when(end["last"].isNotNull(), F.struct(r[_BLOCK].alias("block"), end["last"].alias("row"))).otherwise(now["open"])
        after = F.struct(end["state"].alias("state"), opened.alias("open"))
        return F.struct(after.cast(place).alias("now"), F.concat(done["all"], F.array(now)).alias("all"))

    begin = F.struct(start.cast(place).alias("now"), F.array().cast(f"array<{place}>").alias("all"))
    begins = F.aggregate("runs", begin, follow, lambda done: done["all"])
    each = files.select(_PATH, F.explode(F.arrays_zip(F.col("runs"), begins.alias("begins"))).alias("r"))
    return each.select(
        _PATH, F.col("r.runs")[_BLOCK].alias(_BLOCK), F.col("r.runs")["run"].alias("run"),
        F.col("r.begins.state").alias("begins"), F.col("r.begins.open").alias("earlier"),
    )


def _owners(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The splits in which a piece does not open a record of its own, with those from which records go on there;
    and for every piece of these the piece that opens its record, as (owner_block, owner_row).
    """
    runs = _runs(pieces)
    runs = runs.join(_begins(runs), [*_SPLIT, "run"])

    # Per piece a character: 1 if it opens a record, or if it could.
    def follow(done, p):
        opens = F.when(p["real"] & (done["state"] == _OUTSIDE), "1").otherwise("0")
        return F.struct(_after(done["state"], p["step"]).alias("state"), F.concat(done["all"], opens).alias("all"))

    real = F.array_join(F.transform("pieces", lambda p: p["real"].cast("int").cast("string")), "")
    followed = F.aggregate("pieces", F.struct(F.col("begins").alias("state"), F.lit("").alias("all")), follow, lambda done: done["all"])
    calm = ~F.col("marked") & (F.col("begins") == _OUTSIDE)
    runs = runs.withColumn("real", real).withColumn("opens", F.when(calm, F.col("real")).otherwise(followed))

    first = F.instr("opens", "1")
    after = F.when(first == 0, "").otherwise(F.substr("real", first))
    runs = runs.withColumn("goes_on", (first != 1) & F.col("earlier").isNotNull())
    odd = runs.where((F.col("opens") != F.col("real")) | F.contains(after, F.lit("0")) | F.col("goes_on"))
    both = F.array(F.col(_BLOCK), F.when(F.col("goes_on"), F.col("earlier.block")).otherwise(F.col(_BLOCK)))
    splits = odd.select(_PATH, F.explode(both).alias(_BLOCK)).distinct()

    def owner(p, i):
        last = i + 1 - F.instr(F.reverse(F.substr("opens", F.lit(1), i + 1)), "1")
        here = F.struct(F.col(_BLOCK).alias("block"), F.get("pieces", last)[_ROW].alias("row"))
        return F.struct(p[_ROW].alias(_ROW), F.when((first > 0) & (first <= i + 1), here).otherwise(F.col("earlier")).alias("owner"))

    near = runs.join(F.broadcast(splits), _SPLIT, "left_semi")
    each = near.select(*_SPLIT, F.explode(F.transform("pieces", owner)).alias("p")).where("p.owner IS NOT NULL")
    return splits, each.select(
        *_SPLIT, F.col("p")[_ROW].alias(_ROW), F.col("p.owner.block").alias("owner_block"), F.col("p.owner.row").alias("owner_row")
    )


def _records(pieces: DataFrame, row_tag: str, lexed: bool) -> DataFrame:
    """(value, path, block, row): the text of each record from behind its opening ``<row_tag``.

    In most splits every opening tag opens a record and every piece is one. Only the texts of
    the splits where that is not so are shuffled, to be put together by record. The list
    of these splits is broadcast; there is at most one for every split of the input.
    """
    if not lexed:
        return pieces.where("real").drop("real")
    splits, owned = _owners(pieces)
    plain = pieces.where("real").join(F.broadcast(splits), _SPLIT, "left_anti")
    apart = pieces.join(F.broadcast(splits), _SPLIT, "left_semi").join(owned, _PIECE)
    texts = F.array_sort(F.collect_list(F.struct(_BLOCK, _ROW, "value")))
    joined = apart.groupBy(_PATH, "owner_block", "owner_row").agg(texts.alias("parts")).select(
        F.array_join(F.transform("parts", lambda p: p["value"]), f"<{row_tag}").alias("value"),
        _PATH, F.col("owner_block").alias(_BLOCK), F.col("owner_row").alias(_ROW),
    )
    return plain.select("value", *_PIECE).unionByName(joined)


# -- reading and writing ----------------------------------------------------------


def read_xml(
    spark: SparkSession,
    path,
    schema: T.StructType,
    row_tag: str = "vulnerability",
    encoding: str = "utf-8",
    on_error: str = "fail",
    order: bool = False,
    comments: bool = True,
) -> DataFrame:
    """One row per ``row_tag`` element, self-closing ones included; elements in comments are left out.

    ``encoding``: ``utf-8``, ``latin-1`` or ``auto`` (Latin-1 for the files that
    are not valid UTF-8; costs a pass over the text).
    ``on_error``: ``fail``, ``keep`` (adds ``_corrupt_record``), ``drop``, or
    ``empty`` (no rows of a file with a malformed record).
    ``order`` adds the document-order columns. ``comments=False`` spares the pass that
    follows comments, CDATA sections and instructions over the text, for files in which
    none of them holds an opening tag and no other tag's name begins with ``row_tag``.
    """
    if encoding not in ("utf-8", "latin-1", "auto"):
        raise ValueError(f"unknown encoding {encoding!r}")
    if on_error not in ("fail", "keep", "drop", "empty"):
        raise ValueError(f"unknown on_error {on_error!r}")

    # What follows the tag's name up to the end of the opening tag; quoted values may hold ">".
    head = r"""^(?:\s(?:[^<>"']++|"[^"<]*"|'[^'<]*')*)?>"""
    pieces = spark.read.option("lineSep", f"<{row_tag}").text(path).select(
        "value", F.col("_metadata.file_path").alias(_PATH), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ROW),
    )
    pieces = _decoded(pieces, spark, path, encoding)
    pieces = pieces.withColumn("real", F.col("value").rlike(head + r"|^/>"))
    records = _records(pieces, row_tag, comments)

    # A record ends with its closing tag; tags in CDATA do not count, and comments go.
    opening = F.regexp_extract("value", head + r"|^/>", 0)
    cut = rf"(?s)(<!\[CDATA\[.*?\]\]>)|(</{row_tag}\s*>).*|<!--.*?-->|<\?.*?\?>"
    body = F.when(F.endswith(opening, F.lit("/>")), opening).otherwise(F.regexp_replace("value", cut, "$1$2"))
    records = records.select(F.concat(F.lit(f"<{row_tag}"), body).alias("record"), *_PIECE)

    target, options = schema, {"rowTag": row_tag, "mode": "FAILFAST"}
    if on_error != "fail":
        target = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options = {"rowTag": row_tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_xml(F.col("record"), target, options)
    beside = [F.col(_PATH)] if on_error == "empty" else []
    if order:
        places = [file_order(F.col(_PATH)), F.col(_BLOCK), F.col(_ROW)]
        records = records.withColumns(dict(zip(DOC_ORDER, places)))
        beside = [*(F.col(c) for c in DOC_ORDER), *beside]
    parsed_once = where_computed(records.select(parsed.alias("r"), *beside), F.col("r").isNotNull())
    rows = parsed_once.select("r.*", *beside)

    if on_error == "drop":
        return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if on_error == "empty":
        bad = rows.where(F.col(CORRUPT).isNotNull()).select(_PATH).distinct()
        return rows.join(bad, _PATH, "left_anti").drop(CORRUPT, _PATH)
    return rows


def write_xml(
    df: DataFrame,
    path: str,
    root_tag: str = "vulnerabilities",
    row_tag: str = "vulnerability",
    mode: str = "errorifexists",
) -> None:
    """Write one element per row; the nesting of the columns is the nesting of the file."""
    (
        df.write.format("xml")
        .mode(mode)
        .option("rootTag", root_tag)
        .option("rowTag", row_tag)
        .option("declaration", 'version="1.0" encoding="UTF-8"')
        .save(path)
    )
