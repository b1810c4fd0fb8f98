"""Resampling many columns to calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.calendar import frequency as frequency_code
from fieldstats.functions.calendar import period_date, periods_from
from fieldstats.functions.coerce import number, numeric_columns, ref, timestamp
from fieldstats.model import Roles
from fieldstats.plans.periods import midnight
from fieldstats.session import use_utc

_FUNCTIONS = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "range": lambda c: F.max(c) - F.min(c),
    "sum": F.sum,
    "count": F.count,
    "std": F.stddev_samp,
}


def check_aggregations(names: Sequence[str]) -> list[str]:
    unique = list(dict.fromkeys(names))
    if not unique:
        raise ValueError("Choose at least one aggregation.")
    unknown = [n for n in unique if n not in fixed.AGGREGATIONS]
    if unknown:
        raise ValueError(f"Unknown aggregation {unknown}. Known: {', '.join(fixed.AGGREGATIONS)}")
    return unique


def value_columns(
    df: DataFrame, time: str, columns: Sequence[str] | None, roles: Roles | None, verify: bool = True
) -> list[str]:
    """The columns to aggregate. ``verify`` drops those without a single numeric value and raises where no time can be read, both found in
    one scan."""
    wanted = list(columns or ()) or list(roles.variables if roles else ()) or numeric_columns(df)
    known = [c for c in wanted if c in df.columns and c != time]
    if verify and known:
        times = F.count(timestamp(df, time)).alias("times")
        found = df.agg(*[F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(known)], times).head()
        known = [c for i, c in enumerate(known) if found[i]]
        if known and not found["times"]:
            raise ValueError(f"Column '{time}' holds no readable time.")
    if not known:
        raise ValueError("There is no numeric value column to aggregate.")
    return known


def aggregate_columns(columns: Sequence[str], aggregations: Sequence[str]) -> list[Column]:
    return [_FUNCTIONS[a](ref(c)).alias(f"{c}_{a}") for a in aggregations for c in columns]


def fill_gaps(table: DataFrame, outputs: Sequence[str], zeroed: Sequence[str], code: str) -> DataFrame:
    """Lists the periods between a period and the next one as well, with NULLs, or 0 for sums and counts.

    Each period brings the gap after it along, so the aggregate is computed once and joined to nothing. The window
    runs over the calendar-bounded period table.
    """
    following = F.lead("period").over(Window.orderBy("period"))
    listed = table.withColumn("__next", following).withColumn(
        "__label", F.explode(periods_from(F.col("period"), F.col("__next"), code))
    )
    own = F.col("__label") == F.col("period")
    cells = [F.when(own, ref(c)) for c in outputs]
    filled = [F.coalesce(v, F.lit(0)) if c in zeroed else v for c, v in zip(outputs, cells)]
    return listed.select(F.col("__label").alias("period"), *[v.alias(c) for c, v in zip(outputs, filled)])


def temporal_aggregation(
    df: DataFrame,
    time: str | None = None,
    columns: Sequence[str] | None = None,
    frequency: str = "D",
    aggregations: Sequence[str] = fixed.DEFAULT_AGGREGATIONS,
    roles: Roles | None = None,
    verify: bool = True,
) -> DataFrame:
    """One row per period, ``<column>_<aggregation>`` columns, the label in ``period_start``.

    Month and year labels are the last day of the period. Sums and counts are 0 in periods without rows, so asking for
    either lists every period from first to last; otherwise periods without any value are absent.
    """
    use_utc(df.sparkSession)
    time = time or (roles.time if roles else None)
    if not time:
        raise ValueError("A time column is needed. Name one or set the time role.")
    code = frequency_code(frequency)
    aggregations = check_aggregations(aggregations)
    columns = value_columns(df, time, columns, roles, verify)
    # Names of our own until the end, so that a value column may be called anything.
    inner = [f"c{i}" for i in range(len(columns))]
    outputs = [f"{c}_{a}" for a in aggregations for c in inner]
    rows = df.select(
        period_date(timestamp(df, time), code).alias("period"), *[number(df, c).alias(i) for c, i in zip(columns, inner)]
    ).where(F.col("period").isNotNull())
    table = rows.groupBy("period").agg(*aggregate_columns(inner, aggregations))
    zeroed = [f"{c}_{a}" for a in aggregations for c in inner if a in ("sum", "count")]
    if zeroed:
        table = fill_gaps(table, outputs, zeroed, code)
    else:
        table = table.dropna("all", subset=outputs)
    named = [f"{c}_{a}" for a in aggregations for c in columns]
    return table.select(midnight(F.col("period")).alias("period_start"), *[F.col(o).alias(n) for o, n in zip(outputs, named)])
