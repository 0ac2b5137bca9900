"""Readers and writers."""

from vulnspark.sources.ordering import DOC_ORDER, in_sequence, numbered, with_document_order
from vulnspark.sources.pages import read_pages
from vulnspark.sources.records import read_records, write_records
from vulnspark.sources.robots import disallowed_paths
from vulnspark.sources.scan import spread
from vulnspark.sources.xml import read_xml, write_xml

__all__ = [
    "DOC_ORDER",
    "disallowed_paths",
    "in_sequence",
    "numbered",
    "read_pages",
    "read_records",
    "read_xml",
    "spread",
    "with_document_order",
    "write_records",
    "write_xml",
]
