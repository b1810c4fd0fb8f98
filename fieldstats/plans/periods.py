"""The period table: one pass over the rows, one row per calendar period.

Rows that cannot be used (no time or no value) go to the group with a NULL period, so the same pass also yields the
data-quality counts. The table has at most one row per calendar day (under 3.7 million in years 1 to 9999),
whatever the input size; everything computed from it is therefore small. Partial aggregation runs before the
shuffle, so a day holding a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldstats.functions.calendar import period_date
from fieldstats.functions.coerce import naive
from fieldstats.plans.series import usable


def whole() -> WindowSpec:
    """All rows as one window. Only ever used on calendar-bounded tables."""
    return Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def collect_groups(rows: DataFrame, keys: dict[str, Column], spread: bool = False) -> DataFrame:
    """Group a series by ``keys`` (NULL keys for unusable rows) with value statistics and quality counts."""
    ok = usable(rows)
    keyed = rows.select(
        *[F.when(ok, key).alias(name) for name, key in keys.items()],
        F.when(ok, F.col("time")).alias("t"),
        F.when(ok, F.col("value")).alias("v"),
        F.col("time").isNull().alias("no_time"),
        F.col("value").isNull().alias("no_value"),
    )
    aggregates = [
        F.avg("v").alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.count("v").alias("count"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if("no_time").alias("missing_time"),
        F.count_if("no_value").alias("missing_target"),
        F.min("t").alias("first_time"),
        F.max("t").alias("last_time"),
    ]
    if spread:
        aggregates.append((F.var_pop("v") * F.count("v")).alias("m2"))
    return keyed.groupBy(*keys).agg(*aggregates)


def period_groups(rows: DataFrame, code: str) -> DataFrame:
    return collect_groups(rows, {"period": period_date(F.col("time"), code)})


def observed(groups: DataFrame, key: str = "period") -> DataFrame:
    return groups.where(F.col(key).isNotNull())


def coverage(groups: DataFrame, periods: str | None = None, **extra: Column) -> DataFrame:
    """One row: how much was read, how much was usable, and from when to when; ``extra`` aggregates join the same pass."""
    parts = [
        F.sum("rows").alias("source_rows"),
        F.sum("count").alias("valid_rows"),
    ]
    if periods:
        parts.append(F.count_if(F.col("count") > 0).alias(periods))
    parts += [
        naive(F.min("first_time")).alias("start"),
        naive(F.max("last_time")).alias("end"),
        F.sum("missing_time").alias("missing_time"),
        F.sum("missing_target").alias("missing_target"),
    ]
    parts += [expr.alias(name) for name, expr in extra.items()]
    return groups.agg(*parts)


def midnight(period: Column) -> Column:
    return period.cast("timestamp_ntz")


def first_key_of_max(key: str, value: str) -> Column:
    """Key of the largest value; ties go to the smallest key."""
    return F.max_by(key, F.struct(F.col(value), -F.col(key)))


def first_key_of_min(key: str, value: str) -> Column:
    return F.min_by(key, F.struct(F.col(value), F.col(key)))
