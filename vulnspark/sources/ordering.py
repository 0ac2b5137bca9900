"""An explicit document order for rows read from files.

"Last row wins" and "first N rows" need an order that a distributed read does
not have by itself. A row's file, the offset of its split and its position in
the running task sort like the documents do, however the splits are packed. A number
taken from that order (``numbered``) and written with the row outlasts any number of files.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC_ORDER = ("_file", "_block", "_row")


def file_order(path: Column) -> Column:
    """The path, with the number of a part file wide enough to sort as text."""
    number = F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1)
    wide = F.concat(
        F.regexp_extract(path, r"^(.*/part-)\d+[^/]*$", 1), F.lpad(number, 12, "0"), F.regexp_extract(path, r"/part-\d+([^/]*)$", 1)
    )
    return F.when(number == "", path).otherwise(wide)


def document_order_columns() -> list[Column]:
    return [
        file_order(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]


def with_document_order(scan: DataFrame) -> DataFrame:
    """Add the order columns to a DataFrame that is a plain file scan."""
    return scan.select("*", *document_order_columns())


def numbered(rows: DataFrame, name: str, order: Sequence[str] = DOC_ORDER) -> DataFrame:
    """Number rows that have document order, ascending over all files; the order columns go.

    Every split learns how many numbers the splits before it use up, in the order of the files;
    the rows themselves stay where they are. Numbers have gaps where a split holds
    places without a row. The one step over all splits has a row for each, some
    128 MB of input, and so has what is broadcast.
    """
    file, block, row = order
    used = rows.groupBy(file, block).agg(F.min(row).alias("_lo"), F.max(row).alias("_hi"))
    earlier = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("_hi") - F.col("_lo") + 1).over(earlier), F.lit(0))
    splits = used.select(file, block, (before - F.col("_lo")).alias("_shift"))
    return rows.join(F.broadcast(splits), [file, block]).withColumn(name, F.col("_shift") + F.col(row)).drop(*order, "_shift")


def in_sequence(rows: DataFrame, name: str, peek: DataFrame | None = None) -> DataFrame:
    """Rows with document order and a column for their number: numbered now, unless their files carry the numbers.

    Of the files of one read either all carry them or none does; the first row tells. ``peek``
    may be a cheaper way to a first row; if it has none, the rows are asked.
    """
    first = None if peek is None else peek.select(name).first()
    if first is None:
        first = rows.select(name).first()
    if first is not None and first[0] is None:
        return numbered(rows.drop(name), name)
    return rows.drop(*DOC_ORDER)
