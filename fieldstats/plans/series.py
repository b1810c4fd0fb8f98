"""The two-column series every time analysis starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from fieldstats.functions.coerce import number, timestamp
from fieldstats.session import use_utc


def series(df: DataFrame, time: str | None, target: str | None) -> DataFrame:
    """``time`` and ``value``, coerced, with NULL where a cell could not be read. Rows are kept."""
    if not time:
        raise ValueError("A time column is needed. Name one or set the time role.")
    if not target:
        raise ValueError("A numeric target column is needed. Name one or set the variable roles.")
    use_utc(df.sparkSession)
    return df.select(timestamp(df, time).alias("time"), number(df, target).alias("value"))


def usable(rows: DataFrame) -> Column:
    return rows["time"].isNotNull() & rows["value"].isNotNull()


def clean(rows: DataFrame) -> DataFrame:
    return rows.where(usable(rows))
