"""Straight-line trends: over raw time points, and over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.coerce import naive, numeric_columns
from fieldstats.model import Result, Roles
from fieldstats.operators.common import Bundle
from fieldstats.plans import periods
from fieldstats.plans.series import clean, series


def direction(slope: Column) -> Column:
    return F.when(slope > 0, "increasing").when(slope < 0, "decreasing").when(slope == 0, "stable")


def trend_target(df: DataFrame, roles: Roles | None, kind: str = "trend_detection") -> str:
    """First variable the kind hints at, else the first variable, else the first numeric column."""
    roles = roles or Roles()
    hints = {
        "temperature_trend": fixed.TEMPERATURE_HINTS,
        "precipitation_trend": fixed.PRECIPITATION_HINTS,
    }.get(kind, ())
    found = roles.hinted(hints) or roles.target or next(iter(numeric_columns(df)), None)
    if not found:
        raise ValueError("There is no numeric column to fit a trend to.")
    return found


def trend_fit(rows: DataFrame) -> DataFrame:
    """One row: least squares of value on unix seconds."""
    seconds = F.unix_micros("time") / F.lit(1e6)
    return (
        clean(rows)
        .select(seconds.alias("x"), F.col("value").alias("y"))
        .agg(
            F.count("y").alias("rows"),
            F.regr_slope("y", "x").alias("slope_per_second"),
            F.regr_intercept("y", "x").alias("intercept"),
            F.regr_r2("y", "x").alias("r2"),
        )
        .withColumn("trend_direction", direction(F.col("slope_per_second")))
    )


def trend_points(rows: DataFrame, line: DataFrame) -> DataFrame:
    """Each usable point with its fitted value; the one-row fit is broadcast, the points are not shuffled."""
    ends = line.select("slope_per_second", "intercept")
    seconds = F.unix_micros("time") / F.lit(1e6)
    return (
        clean(rows)
        .crossJoin(F.broadcast(ends))
        .select(
            naive(F.col("time")).alias("time"),
            "value",
            (F.col("slope_per_second") * seconds + F.col("intercept")).alias("fitted"),
        )
    )


def trend_detection(
    df: DataFrame,
    time: str | None = None,
    target: str | None = None,
    roles: Roles | None = None,
    kind: str = "trend_detection",
    checked: bool = False,
) -> Result:
    roles = roles or Roles()
    target = target or trend_target(df, roles, kind)
    rows = series(df, time or roles.time, target)
    line = trend_fit(rows)
    bundle = Bundle(checked)
    line = bundle.hold(line)
    bundle.require(line, "rows", fixed.MIN_ROWS, "valid time points")
    return bundle.result(
        kind,
        facts={"fit": line},
        records={"points": lambda: trend_points(rows, line)},
        info={"time_column": time or roles.time, "target_column": target},
    )


def yearly_means(days: DataFrame) -> DataFrame:
    """Statistics of the period means of each year. Input and output are calendar-bounded."""
    return days.groupBy(F.year("period").alias("year")).agg(
        F.avg("mean").alias("mean"),
        F.stddev_samp("mean").alias("std"),
        F.min("mean").alias("min"),
        F.max("mean").alias("max"),
        F.count("mean").alias("count"),
    )


def year_line(years: DataFrame, value: str, output: str, at_least: int = 1) -> DataFrame:
    """Adds the fitted line over years; a window, so that the years are not computed twice."""
    slope = F.regr_slope(value, "year").over(periods.whole())
    intercept = F.regr_intercept(value, "year").over(periods.whole())
    line = slope * F.col("year") + intercept
    if at_least > 1:
        line = F.when(F.count(F.lit(1)).over(periods.whole()) >= at_least, line)
    return years.withColumn(output, line)


def year_summary(years: DataFrame) -> DataFrame:
    slope = F.regr_slope("mean", "year")
    enough = F.count(F.lit(1)) >= fixed.MIN_YEARS
    fitted = {
        "slope_per_year": slope,
        "slope_per_decade": slope * 10,
        "total_change": slope * (F.max("year") - F.min("year")),
        "r2": F.regr_r2("mean", "year"),
        "trend_direction": direction(slope),
    }
    return years.agg(
        *[F.when(enough, c).alias(n) for n, c in fitted.items()],
        periods.first_key_of_min("year", "mean").alias("lowest_year"),
        F.min("mean").alias("lowest_value"),
        periods.first_key_of_max("year", "mean").alias("highest_year"),
        F.max("mean").alias("highest_value"),
    )


def annual_trend_signal(
    df: DataFrame,
    time: str | None = None,
    target: str | None = None,
    roles: Roles | None = None,
    checked: bool = False,
) -> Result:
    """Trend of yearly means of daily means."""
    roles = roles or Roles()
    time, target = time or roles.time, target or roles.target
    bundle = Bundle(checked)
    groups = bundle.hold(periods.period_groups(series(df, time, target), "D"))
    days = periods.observed(groups)
    years = yearly_means(days)
    observed_years = F.count_distinct(F.year("period"))
    bundle.require_coverage(groups)
    bundle.require(lambda: years.agg(F.count(F.lit(1)).alias("n")), "n", fixed.MIN_YEARS, "observed years")
    return bundle.result(
        "annual_trend_signal",
        facts={
            "coverage": lambda: periods.coverage(groups, "daily_periods", annual_periods=observed_years),
            "summary": lambda: year_summary(years),
        },
        records={"annual_series": lambda: year_line(years, "mean", "trend")},
        info={"time_column": time, "target_column": target},
    )
