"""Disallowed paths of a robots text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import strip


def disallowed_paths(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row (plus the input's other columns) per line that starts with ``Disallow:``."""
    others = [c for c in lines.columns if c != line]
    rule = F.col(line)
    path = strip(rule.substr(F.lit(len("Disallow:") + 1), F.length(rule)))
    return lines.where(rule.startswith("Disallow:")).select(*others, path.alias("path"))
