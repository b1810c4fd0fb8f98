"""Days beyond high and low quantile thresholds, counted per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.options import option
from fieldstats.model import Result, Roles
from fieldstats.operators.common import Bundle
from fieldstats.operators.trend import year_line
from fieldstats.plans import periods
from fieldstats.plans.series import series


def thresholds(days: DataFrame, high: float, low: float) -> DataFrame:
    """One row. Exact: the period table is calendar-bounded, so its distinct values are too."""
    return days.agg(
        F.lit(high).alias("high_quantile"),
        F.lit(low).alias("low_quantile"),
        F.percentile("max", F.lit(high)).alias("high_threshold"),
        F.percentile("min", F.lit(low)).alias("low_threshold"),
    )


def year_counts(days: DataFrame, high: float, low: float) -> DataFrame:
    """Per year: periods whose maximum reaches the high, or whose minimum reaches the low threshold."""
    return _years_with_limits(days, high, low).drop("high_threshold", "low_threshold")


def _years_with_limits(days: DataFrame, high: float, low: float) -> DataFrame:
    """The counts per year, with the thresholds on every row, so that one scan gives both."""
    limited = days.withColumns(
        {
            "high_limit": F.percentile("max", F.lit(high)).over(periods.whole()),
            "low_limit": F.percentile("min", F.lit(low)).over(periods.whole()),
        }
    )
    return limited.groupBy(F.year("period").alias("year")).agg(
        F.count_if(F.col("max") >= F.col("high_limit")).alias("high_days"),
        F.count_if(F.col("min") <= F.col("low_limit")).alias("low_days"),
        F.count("mean").alias("observed_days"),
        F.max("high_limit").alias("high_threshold"),
        F.max("low_limit").alias("low_threshold"),
    )


def limits_and_counts(days: DataFrame, high: float, low: float) -> DataFrame:
    """One row: the quantiles, their thresholds and the summary of the yearly counts."""
    return _years_with_limits(days, high, low).agg(
        F.lit(high).alias("high_quantile"),
        F.lit(low).alias("low_quantile"),
        F.max("high_threshold").alias("high_threshold"),
        F.max("low_threshold").alias("low_threshold"),
        *_count_parts(),
    )


def annual_extremes(days: DataFrame, high: float, low: float) -> DataFrame:
    counts = year_counts(days, high, low)
    counts = year_line(counts, "high_days", "high_trend", fixed.MIN_YEARS)
    return year_line(counts, "low_days", "low_trend", fixed.MIN_YEARS)


def _count_parts() -> list[Column]:
    enough = F.count(F.lit(1)) >= fixed.MIN_YEARS
    fits = {
        "high_trend_per_decade": F.regr_slope("high_days", "year") * 10,
        "low_trend_per_decade": F.regr_slope("low_days", "year") * 10,
        "high_r2": F.regr_r2("high_days", "year"),
        "low_r2": F.regr_r2("low_days", "year"),
    }
    return [
        *[F.when(enough, expr).alias(name) for name, expr in fits.items()],
        F.sum("high_days").alias("high_total_days"),
        F.sum("low_days").alias("low_total_days"),
        periods.first_key_of_max("year", "high_days").alias("max_high_year"),
        F.max("high_days").alias("max_high_days"),
        periods.first_key_of_max("year", "low_days").alias("max_low_year"),
        F.max("low_days").alias("max_low_days"),
    ]


def extreme_events(
    df: DataFrame,
    time: str | None = None,
    target: str | None = None,
    roles: Roles | None = None,
    high_quantile: object = None,
    low_quantile: object = None,
    checked: bool = False,
) -> Result:
    roles = roles or Roles()
    time, target = time or roles.time, target or roles.target
    high = option(high_quantile, fixed.HIGH_QUANTILE)
    low = option(low_quantile, fixed.LOW_QUANTILE)
    if low >= high:
        raise ValueError(f"The low quantile ({low}) must be below the high one ({high}).")
    bundle = Bundle(checked)
    groups = bundle.hold(periods.period_groups(series(df, time, target), "D"))
    bundle.require_coverage(groups)
    days = periods.observed(groups)

    def summary() -> DataFrame:
        return limits_and_counts(days, high, low).drop("high_quantile", "low_quantile")

    return bundle.result(
        "extreme_events",
        facts={
            "coverage": lambda: periods.coverage(
                groups, "daily_periods", annual_periods=F.count_distinct(F.year("period"))
            ),
            "thresholds": lambda: thresholds(days, high, low),
            "summary": summary,
        },
        records={"annual_extremes": lambda: annual_extremes(days, high, low)},
        info={"time_column": time, "target_column": target},
    )
