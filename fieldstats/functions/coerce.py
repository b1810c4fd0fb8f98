"""Turning source columns into the two types the operators compute with: UTC timestamp and double."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats import fixed

# Text such as 1d or 2.5F is a Java literal, not a number in a data file.
_JAVA_LITERAL = r"[0-9.][dDfF]$"
# All that the listed patterns can match: digits, month names, their separators.
_MAY_BE_TIME = r"^(?=[^0-9]*[0-9])[0-9A-Za-z/:, -]{8,40}$"


#: What each part of a pattern can match; a pattern is tried only on cells of its shape.
_PARTS = re.compile(r"MMMM?|yyyy|MM|dd|HH|mm|ss|M|d|H|.")
_SHAPES = {"MMM": "[A-Za-z]{3,9}", "MMMM": "[A-Za-z]{3,9}", "yyyy": "[0-9]{4}", "M": "[0-9]+", "d": "[0-9]+", "H": "[0-9]+"}


def _shape(pattern: str) -> str:
    parts = [_SHAPES.get(p) or ("[0-9]{2}" if p.isalpha() else re.escape(p)) for p in _PARTS.findall(pattern)]
    return "^" + "".join(parts) + "$"


def _listed_time(column: Column) -> Column:
    """By the first listed pattern that fits: the shape of a cell, which digits, letters and separators stand where, leaves one pattern, or two that
    write the month short and in full."""
    groups: dict[str, list[str]] = {}
    for pattern in fixed.DATETIME_PATTERNS:
        groups.setdefault(_shape(pattern), []).append(pattern)
    out = F
    for shape, patterns in groups.items():
        out = out.when(column.rlike(shape), F.coalesce(*[F.try_to_timestamp(column, F.lit(p)) for p in patterns]))
    return out


def ref(name: str) -> Column:
    """A column by exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def field_type(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"Column '{name}' is not in the table. Columns: {', '.join(df.columns)}")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric features: integers, floats and decimals, not booleans."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def number_expr(column: Column, data_type: T.DataType) -> Column:
    """Double, with bad text and NaN as NULL."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        wide = column.cast("double")
        return F.when(~F.isnan(wide), wide)
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        text = F.trim(column)
        parsed = text.try_cast("double")
        return F.when(~text.rlike(_JAVA_LITERAL) & ~F.isnan(parsed), parsed)
    return F.lit(None).cast("double")


def time_expr(column: Column, data_type: T.DataType, pattern: str | None = None) -> Column:
    """UTC timestamp, with bad text as NULL. Plain numbers count nanoseconds since 1970.

    Text is read cell by cell: by ``pattern`` if there is one, else as an ISO form or by the first listed pattern that fits.
    """
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp")
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        if pattern:
            return F.try_to_timestamp(column, F.lit(pattern))
        # Failed parses are slow; text that is no time does not get that far.
        return F.coalesce(column.try_cast("timestamp"), F.when(column.rlike(_MAY_BE_TIME), _listed_time(column)))
    if isinstance(data_type, T.IntegralType):
        return F.timestamp_micros(F.floor(column / F.lit(1000)).cast("long"))
    if isinstance(data_type, T.NumericType):
        nanos = number_expr(column, data_type)
        return F.timestamp_micros(F.floor(nanos / F.lit(1000.0)).try_cast("long"))
    return F.lit(None).cast("timestamp")


def number(df: DataFrame, name: str) -> Column:
    return number_expr(ref(name), field_type(df, name))


def present(df: DataFrame, name: str) -> Column:
    """A cell that is neither NULL nor NaN; text counts even when it is not a number."""
    column = ref(name)
    if isinstance(field_type(df, name), (T.FloatType, T.DoubleType)):
        return column.isNotNull() & ~F.isnan(column)
    return column.isNotNull()


def timestamp(df: DataFrame, name: str, pattern: str | None = None) -> Column:
    return time_expr(ref(name), field_type(df, name), pattern)


def require_times(df: DataFrame, name: str) -> None:
    """Raises when no cell of a time column can be read. Stops at the first that can."""
    if not df.select(timestamp(df, name).alias("t")).where("t is not null").head(1):
        raise ValueError(f"Column '{name}' holds no readable time.")


def naive(column: Column) -> Column:
    """UTC timestamp without a zone, the form every output table uses."""
    return column.cast("timestamp_ntz")
