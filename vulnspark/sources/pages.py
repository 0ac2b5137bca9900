"""Stored pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path, attack: str | None = None) -> DataFrame:
    """(url, html, attack) from HTML files, one page per file; the name is the order.

    ``attack`` is the search term the pages were found under. Many small files are
    better kept as one Parquet table with these columns.
    """
    pages = spark.read.text(path, wholetext=True)
    return pages.select(
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
        F.lit(attack).cast("string").alias("attack"),
    )
