"""Tables and results to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats.functions.coerce import ref, timestamp
from fieldstats.model import Result
from fieldstats.plans.ranks import ranked_between
from fieldstats.sources.readers import YEAR_FOLDER


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", year_of: str | None = None) -> None:
    """Parquet; with ``year_of`` (a time column), one folder per year. ``read_table`` leaves the folder's column out."""
    if not year_of:
        df.write.mode(mode).parquet(path)
        return
    if YEAR_FOLDER in df.columns:
        raise ValueError(f"'{YEAR_FOLDER}' names the folders of years; rename the column.")
    df.withColumn(YEAR_FOLDER, F.year(timestamp(df, year_of))).write.mode(mode).partitionBy(YEAR_FOLDER).parquet(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, since CSV has no nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            (F.to_json(ref(f.name)) if isinstance(f.dataType, nested) else ref(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes in cells are doubled, as ``read_csv`` and most other readers have it."""
    csv_ready(df).write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def export_result(result: Result, path: str, mode: str = "errorifexists") -> None:
    """The result's primary table as CSV."""
    write_csv(result.primary(), path, mode)


def export_tables(result: Result, path: str, mode: str = "errorifexists") -> None:
    """Every table of the result, one folder each."""
    for name in result.names():
        write_csv(result[name], f"{path.rstrip('/')}/{name}", mode)


def _behind(keys: list[Column], values: Sequence[object]) -> Column:
    """Is the row after these key values? NULL comes first."""
    later, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, values):
        beyond = key.isNotNull() if value is None else F.coalesce(key > F.lit(value), F.lit(False))
        later = later | (same & beyond)
        same = same & key.eqNullSafe(F.lit(value))
    return later


def page(df: DataFrame, order_by: Sequence[str], limit: int, offset: int = 0, after: Sequence[object] | None = None) -> DataFrame:
    """A page of an ordered table; NaN becomes NULL.

    With ``after``, the values of the ``order_by`` columns in the last row seen, the page begins behind them: nothing before is read twice or
    sorted. Else ``offset`` rows are passed over; counts of key ranges say where the page lies, and only that range is sorted.
    """
    if not order_by:
        raise ValueError("A page needs an order; name the columns to order by.")
    keys = [ref(c) for c in order_by]
    if after is not None:
        if len(after) != len(keys):
            raise ValueError(f"'after' needs a value for each of {', '.join(order_by)}.")
        df = df.where(_behind(keys, after))
    if offset:
        df = ranked_between(df, keys, offset, limit)
    rows = df.orderBy(*keys).limit(limit)
    shown = []
    for f in df.schema.fields:
        column = ref(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            column = F.when(~F.isnan(column), column)
        shown.append(column.alias(f.name))
    return rows.select(*shown)
