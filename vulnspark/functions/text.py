"""Scalar text expressions.

All of them are built-in functions, so they stay inside the JVM. Word and space
classes are spelled out because Java's ``\\w`` and ``\\s`` cover ASCII only while
the semantics here are Unicode ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space in Unicode text.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"
CASED_RUN = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]+"
DECIMAL = rf"^{SPACE}*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?{SPACE}*$"

UNKNOWN = "unknown"


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """White-space runs become one blank, ends are trimmed."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def or_unknown(c: Column) -> Column:
    """Null and empty text become ``unknown``."""
    return F.when(is_empty(c), UNKNOWN).otherwise(c)


def or_empty(c: Column) -> Column:
    """Trimmed text, null as empty text."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def link_labels(c: Column) -> Column:
    """Replace Markdown links by their labels; missing text is ``unknown``."""
    return F.when(is_empty(c), UNKNOWN).otherwise(
        F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    )


def clean_title(c: Column) -> Column:
    """Drop the ``Title:`` prefix, link targets, script names, private names and
    a repeated "injection". The outcome may be empty."""
    t = link_labels(F.regexp_replace(c, rf"^Title:{SPACE}*", ""))
    script = rf"{NOT_AFTER_WORD}{WORD}+\.py{NOT_BEFORE_WORD}"
    private = rf"{NOT_AFTER_WORD}_[a-zA-Z0-9_]+{NOT_BEFORE_WORD}"
    word = rf"{NOT_AFTER_WORD}(injection){NOT_BEFORE_WORD}"
    again = rf"(?i){word}[^\n]*{NOT_AFTER_WORD}injection{NOT_BEFORE_WORD}"
    t = F.regexp_replace(t, script, "")
    t = F.regexp_replace(t, private, "")
    t = F.regexp_replace(t, again, "$1")
    return F.when(is_empty(c), UNKNOWN).otherwise(squeeze(t))


def flat_text(c: Column) -> Column:
    """Line breaks and tabs become blanks, blank runs shrink to one, ends are trimmed."""
    runs = r"[\r\n\t][ \r\n\t]*| [ \r\n\t]+"
    return F.coalesce(strip(F.regexp_replace(c, runs, " ")), F.lit(""))


def vendor_name(c: Column) -> Column:
    """Drop leading digits and non-word characters; nothing left is ``Unknown``."""
    name = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[^\p{L}\p{Nl}\p{No}_]+", ""))
    return F.when(name == "", "Unknown").otherwise(name)


def correct(c: Column, corrections: Mapping[str, str]) -> Column:
    """Trimmed text, replaced where a (small) dictionary names a correction."""
    name = F.coalesce(strip(c), F.lit(""))
    if not corrections:
        return name
    pairs = [F.lit(x) for kv in corrections.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def first_upper(c: Column) -> Column:
    """Capitalise the first character, keep the rest.

    The upper case of one character may be several ("ß" gives "SS"); only the
    first of them stays upper.
    """
    head = F.upper(F.substring(c, 1, 1))
    return F.concat(F.substring(head, 1, 1), F.lower(head.substr(F.lit(2), F.length(head))),
                    c.substr(F.lit(2), F.length(c)))


def capitalize(c: Column) -> Column:
    return first_upper(F.lower(c))


def title_case(c: Column) -> Column:
    """Capitalise every run of cased letters: ``cross-site`` gives ``Cross-Site``."""
    runs = F.regexp_extract_all(
        F.lower(c), F.lit(rf"{CASED_RUN}|[^\p{{IsLowercase}}\p{{IsUppercase}}\p{{Lt}}]+"), F.lit(0)
    )
    return F.array_join(F.transform(runs, first_upper), "")


def attack_name(c: Column) -> Column:
    return title_case(squeeze(c))


def number(c: Column) -> Column:
    """Text to double, null where the text is not a plain decimal number."""
    return F.when(c.rlike(DECIMAL), strip(c).try_cast("double"))


def fixed(c: Column, decimals: int) -> Column:
    """Number to text with fixed decimals, rounded half-even on its exact value."""
    return F.call_function("format_number", c, F.lit("0." + "0" * decimals))


def iso_date(c: Column) -> Column:
    """Strict year-month-day parse, padded or not; anything else is null."""
    return F.try_to_date(c, "yyyy-M-d")


# Formats of dates with a time that the timeline accepts besides plain dates.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss", "yyyy/M/d", "M/d/yyyy",
)


def any_date(c: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """The day of a plain date or of a text in one of the formats, the first that fits; else null."""
    return F.coalesce(iso_date(c), *(F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats))


# Formats of dates that a column may have as a whole. Where day and month could both be meant, the month comes first.
COLUMN_FORMATS = (
    "yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "d MMM yyyy", "MMM d, yyyy",
)


def format_of(c: Column, formats: Sequence[str] = COLUMN_FORMATS) -> Column:
    """The number of the first format that a text fits, null if it fits none."""
    which = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(formats))):
        which = F.when(F.try_to_timestamp(strip(c), F.lit(f)).isNotNull(), i).otherwise(which)
    return which


def date_in(c: Column, which: Column, formats: Sequence[str] = COLUMN_FORMATS) -> Column:
    """The day of a text in the format of that number; null if it does not fit it."""
    day = F.lit(None).cast("date")
    for i, f in enumerate(formats):
        day = F.when(which == i, F.to_date(F.try_to_timestamp(strip(c), F.lit(f)))).otherwise(day)
    return day


def present_or(c: Column, default: str) -> Column:
    """Trimmed text; absent, blank, ``unknown`` and ``Unknown`` give the default."""
    text = strip(c)
    missing = text.isNull() | text.isin("", "unknown", "Unknown")
    return F.when(missing, F.lit(default)).otherwise(text)


def is_unknown(c: Column) -> Column:
    # The length comes first: a long text is not worth its lower-case copy.
    return F.coalesce((F.length(c) == len(UNKNOWN)) & (F.lower(c) == UNKNOWN), F.lit(False))


def one_of_levels(c: Column, levels: Sequence[str]) -> Column:
    """1-based rank of a level in a fixed order, null when it is none of them."""
    ranks = [F.lit(x) for pair in zip(levels, range(1, len(levels) + 1)) for x in pair]
    return F.try_element_at(F.create_map(*ranks), c)
