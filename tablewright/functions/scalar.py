"""Text, number, date and JSON helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.plans.types import epoch_micros, is_nested, quoted

TEXT_LIMIT = 2000
NAME_LIMIT = 100
FILE_NAME_LIMIT = 255


def sanitize_text(col: Column, limit: int = TEXT_LIMIT) -> Column:
    """Strip tags, escape what HTML reserves (ampersand first), cut to ``limit`` characters."""
    out = F.regexp_replace(col, r"<[^>]*>", "")
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.substring(out, 1, limit)


def sanitize_name(col: Column) -> Column:
    """Drop characters outside letters, digits, blanks and ``_ - ' . @``."""
    return F.substring(F.regexp_replace(col, r"(?U)[^\w\s\-'.@]", ""), 1, NAME_LIMIT)


def sanitize_file_name(col: Column) -> Column:
    """Replace what may not stand in a file name by underscores."""
    return F.substring(F.regexp_replace(col, r"[^A-Za-z0-9_.-]", "_"), 1, FILE_NAME_LIMIT)


def short_repr(col: Column, limit: int = 24) -> Column:
    text = col.cast("string")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def to_number(col: Column) -> Column:
    """Double, or null where the text is no number."""
    return col.try_cast("double")


def epoch_seconds(col: Column) -> Column:
    """Seconds since 1970 of a date or of text that reads as one; null where it does not."""
    return epoch_micros(col) / 1e6


def text_epoch_seconds(col: Column, pattern: str | None = None) -> Column:
    parsed = F.try_to_timestamp(col, F.lit(pattern)) if pattern else F.try_to_timestamp(col)
    return epoch_micros(parsed) / 1e6


def bool_to_double(col: Column) -> Column:
    return col.cast("int").cast("double")


def weekday(col: Column) -> Column:
    """Day of the week with Sunday as 0."""
    return F.dayofweek(col) - 1


def nested_to_json(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as JSON text."""
    return df.select(
        *[F.to_json(quoted(f.name)).alias(f.name) if is_nested(f.dataType) else quoted(f.name) for f in df.schema]
    )
