"""JSON records, as lines or as arrays.

A JSON array has no lines to split it at. It is cut after every closing brace instead. Which
braces stand in strings follows from the parity of the quotes before them, how deep a brace
lies from the sum of what opens and closes before it; both are running sums, first
within the splits of a file and then over them. A record ends where the depth falls back to
that of the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.sources.ordering import DOC_ORDER, document_order_columns, file_order

_PATH, _BLOCK, _ROW = "_json_path", "_json_block", "_json_row"
_SPLIT = [_PATH, _BLOCK]


def _balance(text: Column) -> Column:
    """What opens less what closes."""

    def others(mark: str) -> Column:
        return F.length(F.replace(text, F.lit(mark), F.lit("")))

    return (others("]") + others("}") - others("[") - others("{")).cast("long")


def _sums(pieces: DataFrame) -> DataFrame:
    """Per piece: its quotes, and its balance if it begins outside a string or inside one.

    A piece ends behind a brace, which counts unless it ends up in a string.
    """
    text = F.regexp_replace("value", r"(?s)\\.", "")
    # Without whole strings, up to a string that does not end. All else lies outside if the piece begins inside.
    outside = _balance(F.substring_index(F.regexp_replace(text, '"[^"]*"', ""), '"', 1))
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    odd = quotes % 2 == 1
    return pieces.select(
        _PATH, _BLOCK, _ROW, quotes.cast("long").alias("quotes"),
        (outside - F.when(odd, 0).otherwise(1)).alias("outside"),
        (_balance(text) - outside - F.when(odd, 1).otherwise(0)).alias("inside"),
    )


def _running(column: Column | str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def _placed(sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces with ``ends`` (a record ends with them), and the splits with the record that is open where they begin.

    Both come from sums of numbers; no text is shuffled for them.
    """
    split, file = Window.partitionBy(*_SPLIT).orderBy(_ROW), Window.partitionBy(_PATH).orderBy(_BLOCK)
    parity = _running("quotes", split) % 2
    pieces = sums.withColumn("parity", parity)
    totals = pieces.groupBy(*_SPLIT).agg(
        F.sum("quotes").alias("quotes"),
        F.sum(F.when(F.col("parity") == 0, F.col("outside")).otherwise(F.col("inside"))).alias("if_outside"),
        F.sum(F.when(F.col("parity") == 0, F.col("inside")).otherwise(F.col("outside"))).alias("if_inside"),
    ).withColumn("begins", _running("quotes", file) % 2)
    totals = totals.withColumn("whole", F.when(F.col("begins") == 0, F.col("if_outside")).otherwise(F.col("if_inside")))
    begins = totals.select(*_SPLIT, "begins", _running("whole", file).alias("base"))

    known = pieces.join(F.broadcast(begins), _SPLIT)
    in_string = (F.col("begins") + F.col("parity")) % 2 == 1
    known = known.withColumn("change", F.when(in_string, F.col("inside")).otherwise(F.col("outside")))
    depth = F.col("base") + _running("change", split) + F.col("change")
    # A brace that is text leaves its piece in a string.
    closed = (F.col("begins") + F.col("parity") + F.col("quotes")) % 2 == 0
    ended = known.withColumn("ends", (closed & (depth == 1)).cast("long"))
    ended = ended.withColumn("record", _running("ends", split))

    counts = ended.groupBy(*_SPLIT).agg(F.sum("ends").alias("ends"))
    before = F.when(F.col("ends") > 0, F.struct(F.col(_BLOCK).alias("block"), F.col("ends").alias("record")))
    open_one = F.last(before, ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min(_BLOCK).over(Window.partitionBy(_PATH))
    splits = counts.select(*_SPLIT, F.coalesce(open_one, F.struct(first.alias("block"), F.lit(0).cast("long").alias("record"))).alias("open"))
    return ended.select(*_SPLIT, _ROW, "ends", "record"), splits


def _array_records(spark: SparkSession, path, one_file: bool) -> DataFrame:
    """(text, path, block, row) of every record, the place being that of its first piece."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias(_PATH), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ROW),
    )
    some = pieces.select(_PATH).first() if one_file else None
    if some is not None:
        pieces = pieces.where(F.col(_PATH) == some[0])
    placed, splits = _placed(_sums(pieces))
    # The texts are shuffled once, by split; a record lies in one split but for the last, which may go on.
    parts = pieces.join(placed, [*_SPLIT, _ROW])
    listed = F.array_sort(F.collect_list(F.struct(_ROW, "value")))
    local = parts.groupBy(*_SPLIT, "record").agg(listed.alias("parts"), F.max("ends").alias("ends"), F.min(_ROW).alias(_ROW))
    local = local.select(
        *_SPLIT, "record", "ends", _ROW, F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}")).alias("text")
    ).join(F.broadcast(splits), _SPLIT)
    goes_on = (F.col("record") == 0) & (F.col("open.block") != F.col(_BLOCK))
    owner = F.when(goes_on, F.col("open")).otherwise(F.struct(F.col(_BLOCK).alias("block"), "record"))
    local = local.withColumn("owner", owner)
    whole = local.where(~goes_on & (F.col("ends") == 1)).select("text", _PATH, _BLOCK, _ROW)
    broken = local.where(goes_on | (F.col("ends") == 0)).groupBy(_PATH, "owner").agg(
        F.array_sort(F.collect_list(F.struct(_BLOCK, _ROW, "text"))).alias("parts"), F.max("ends").alias("ends")
    ).where("ends = 1")
    joined = broken.select(
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), _PATH,
        F.get("parts", F.lit(0))[_BLOCK].alias(_BLOCK), F.get("parts", F.lit(0))[_ROW].alias(_ROW),
    )
    return whole.unionByName(joined)


def read_records(
    spark: SparkSession, path, schema: T.StructType, array: bool = False, order: bool = False, one_file: bool = False
) -> DataFrame:
    """Read JSON Lines, or with ``array`` files that hold one JSON array each, or several.

    Both are read by many tasks whatever the size of a file; an array costs a shuffle of
    its text. Elements of an array that are no objects are passed over, a malformed record
    gives a row of nulls, and what follows a record that is cut off is not there.
    ``order`` adds the document-order columns. ``one_file`` reads the arrays of one file only, for a look at them.
    """
    if not array:
        lines = spark.read.schema(schema).json(path)
        return lines.select("*", *document_order_columns()) if order else lines
    record = F.regexp_replace("text", r"^[^{]*", "")
    found = _array_records(spark, path, one_file).select(F.from_json(record, schema).alias("r"), _PATH, _BLOCK, _ROW)
    places = [file_order(F.col(_PATH)), F.col(_BLOCK), F.col(_ROW)]
    return found.select("r.*", *([p.alias(n) for n, p in zip(DOC_ORDER, places)] if order else []))


def write_records(df: DataFrame, path: str, mode: str = "errorifexists", array: bool = False) -> None:
    """Write JSON Lines in UTF-8, or with ``array`` one array per file; null fields are written, not left out."""
    if not array:
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
        return
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("file", F.pmod(F.xxhash64("at"), F.lit(tasks)))
    order = Window.partitionBy("file").orderBy("at")
    first, last = F.lag("at").over(order).isNull(), F.lead("at").over(order).isNull()
    framed = lines.select("file", F.concat(F.when(first, "[\n").otherwise(""), "value", F.when(last, "\n]").otherwise(",")).alias("value"))
    framed.write.mode(mode).partitionBy("file").text(path)
