"""The operators as named queries over the test tables, each with its SQL twin."""

from vulnspark.workloads import (
    explain,
    files,
    markup,
    records,
    relevance,
    statistics,
    text_rules,
)
from vulnspark.workloads.base import WORKLOADS

__all__ = ["WORKLOADS", "explain", "files", "markup", "records", "relevance", "statistics", "text_rules"]
