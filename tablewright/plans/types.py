"""Which columns count as numbers, text or dates, and how a missing cell is recognised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_FLOATS = (T.FloatType, T.DoubleType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> Column:
    """Column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, _DATES)


def is_categorical(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BooleanType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_categorical(f.dataType)]


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so that both count as missing."""
    col = quoted(name)
    if isinstance(df.schema[name].dataType, _FLOATS):
        return F.when(~F.isnan(col), col)
    return col


def rounded(col: Column, digits: int = 6) -> Column:
    """Round half up and fold -0.0 into 0.0."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def epoch_micros(col: Column) -> Column:
    """Microseconds since 1970 of a date or a timestamp without time zone, whatever the session zone."""
    seconds = F.unix_date(col.cast("date")).cast("bigint") * 86400 + F.hour(col) * 3600 + F.minute(col) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), col) * 1_000_000).cast("bigint")
