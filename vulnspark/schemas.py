"""Declared schemas of every table the engine reads or writes.

Nothing is inferred: inference costs a pass over the input and would turn the
textual ``score`` of a raw record into a double.
"""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _struct(*names: str) -> T.StructType:
    return T.StructType(_strings(*names))


# A record's place among all records, which the stages pass on through their files. In
# XML it is an attribute of the record.
SEQ = "_seq"


def with_seq(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())])


CVSS_ITEM = _struct("score", "severity", "version", "vector")
CVSS_XML_ITEM = _struct("score", "severity", "version")
CWE_ITEM = _struct("id", "name")

# One advisory as extracted from a page.
RAW_RECORD = T.StructType(
    _strings("cve_id", "title", "description", "published_date", "last_modified_date")
    + [
        T.StructField("cwe", T.ArrayType(T.StringType())),
        T.StructField("cvss", T.ArrayType(CVSS_ITEM)),
    ]
    + _strings("vendor", "product")
    + [T.StructField("affected_versions", T.ArrayType(T.StringType()))]
    + _strings("attackType")
)

# One advisory after cleaning.
CLEAN_RECORD = T.StructType(
    _strings("cve_id", "title", "description", "published_date", "last_modified_date")
    + [
        T.StructField("cwe", T.ArrayType(CWE_ITEM)),
        T.StructField("cvss", T.ArrayType(CVSS_ITEM)),
    ]
    + _strings("vendor", "product")
    + [T.StructField("affected_versions", T.ArrayType(T.StringType()))]
    + _strings("attack_type")
)

# Nested XML form of a cleaned advisory.
RAW_XML = T.StructType(
    _strings("cve_id", "title", "description")
    + [T.StructField("dates", _struct("published", "last_modified"))]
    + _strings("vendor", "product", "attack_type")
    + [
        T.StructField(
            "cwe_list", T.StructType([T.StructField("cwe", T.ArrayType(CWE_ITEM))])
        ),
        T.StructField(
            "cvss_list",
            T.StructType([T.StructField("cvss", T.ArrayType(CVSS_XML_ITEM))]),
        ),
    ]
)

# The 16-column feature table.
FEATURES = T.StructType(
    _strings("cve_id", "title", "vendor_clean", "attack_type_clean")
    + [
        T.StructField("published_dt", T.DateType()),
        T.StructField("last_modified_dt", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("cvss_score", T.DoubleType()),
        T.StructField("severity_level", T.StringType()),
        T.StructField("severity_numeric", T.IntegerType()),
        T.StructField("cwe_count", T.IntegerType()),
    ]
    + _strings("cwe_ids", "cwe_names_clean")
    + [
        T.StructField("description_length", T.IntegerType()),
        T.StructField("has_cvss", T.IntegerType()),
    ]
    + _strings("description")
)

# Nested XML form of the feature table; every leaf is read as text.
FEATURE_XML = T.StructType(
    _strings("cve_id", "title", "vendor", "attack_type")
    + [T.StructField("dates", _struct("published", "last_modified"))]
    + _strings("year")
    + [
        T.StructField(
            "cvss_features",
            _struct("score", "severity_level", "severity_numeric", "has_cvss"),
        ),
        T.StructField("cwe_features", _struct("cwe_count", "cwe_ids", "cwe_names")),
        T.StructField("description_features", _struct("length", "text")),
    ]
)

# Table behind the dashboard.
DASHBOARD = T.StructType(
    _strings("cve_id", "title", "description")
    + [T.StructField("cvss_score", T.DoubleType())]
    + _strings("severity", "attack_type", "cwe", "vendor", "published", "last_modified")
)

# Table behind the exploratory report.
EDA = T.StructType(
    _strings("cve_id", "vendor", "attack_type")
    + [T.StructField("cvss_score", T.DoubleType())]
    + _strings("severity", "published")
)

EXPLANATIONS = _struct(
    "cve_id",
    "title",
    "vendor",
    "attack_type",
    "severity",
    "score",
    "description",
    "ai_explanation",
)
