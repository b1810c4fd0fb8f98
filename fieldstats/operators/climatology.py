"""Mean cycles: through the year and through the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions import calendar
from fieldstats.functions.options import option
from fieldstats.model import Result, Roles
from fieldstats.operators.common import Bundle
from fieldstats.plans import periods
from fieldstats.plans.moments import merge_groups
from fieldstats.plans.series import series

_STATS = ("mean", "std", "min", "max")


def _complete(stats: DataFrame, dimension: DataFrame, *keys: str) -> DataFrame:
    """Every member of a fixed dimension, those without rows with a zero count."""
    return dimension.join(F.broadcast(stats), list(keys), "left").select(*keys, *_STATS, F.coalesce("count", F.lit(0)).alias("count"))


def month_groups(rows: DataFrame) -> DataFrame:
    """At most 13 rows: statistics of the raw rows per month of the year."""
    return periods.collect_groups(rows, {"month": F.month("time")}, spread=True)


def month_climatology(groups: DataFrame) -> DataFrame:
    months = merge_groups(periods.observed(groups, "month"), "month")
    full = _complete(months, calendar.months(groups.sparkSession), "month")
    return full.select("month", calendar.month_label(F.col("month")).alias("month_label"), *_STATS, "count")


def season_cycle(groups: DataFrame) -> DataFrame:
    keyed = periods.observed(groups, "month").withColumn("season", calendar.season(F.col("month")))
    return _complete(merge_groups(keyed, "season"), calendar.seasons(groups.sparkSession), "season")


def _month_summary(groups: DataFrame) -> DataFrame:
    months = periods.observed(groups, "month")
    return months.agg(
        F.try_divide(F.sum(F.col("mean") * F.col("count")), F.sum("count")).alias("annual_mean"),
        periods.first_key_of_max("month", "mean").alias("warmest_month"),
        F.max("mean").alias("warmest_value"),
        periods.first_key_of_min("month", "mean").alias("coolest_month"),
        F.min("mean").alias("coolest_value"),
        (F.max("mean") - F.min("mean")).alias("seasonal_range"),
    ).select(
        "annual_mean",
        "warmest_month",
        calendar.month_label(F.col("warmest_month")).alias("warmest_month_label"),
        "warmest_value",
        "coolest_month",
        calendar.month_label(F.col("coolest_month")).alias("coolest_month_label"),
        "coolest_value",
        "seasonal_range",
    )


def _quality(groups: DataFrame, key: str, observed: str, complete: str, size: int) -> DataFrame:
    seen = F.count_distinct(key)
    return groups.agg(
        F.sum("missing_time").alias("missing_time"),
        F.sum("missing_target").alias("missing_target"),
        seen.alias(observed),
        (seen == size).alias(complete),
    )


def seasonal_patterns(
    df: DataFrame,
    time: str | None = None,
    target: str | None = None,
    roles: Roles | None = None,
    checked: bool = False,
) -> Result:
    """Month-of-year and season statistics of the raw rows, from one scan into 12 groups."""
    roles = roles or Roles()
    time, target = time or roles.time, target or roles.target
    bundle = Bundle(checked)
    groups = bundle.hold(month_groups(series(df, time, target)))
    bundle.require_coverage(groups, periods=False)

    def pattern(key: str, table: DataFrame) -> DataFrame:
        return table.where(F.col("mean").isNotNull()).select(key, F.col("mean").alias("mean_value"))

    return bundle.result(
        "seasonal_patterns",
        facts={
            "coverage": lambda: periods.coverage(groups).drop("missing_time", "missing_target"),
            "data_quality": lambda: _quality(groups, "month", "observed_months", "complete_12_month_profile", 12),
            "summary": lambda: _month_summary(groups),
        },
        records={
            "monthly_climatology": lambda: month_climatology(groups),
            "seasonal_cycle": lambda: season_cycle(groups),
            "monthly_pattern": lambda: pattern("month", month_climatology(groups)),
            "seasonal_pattern": lambda: pattern("season", season_cycle(groups)),
        },
        info={"time_column": time, "target_column": target},
    )


def hour_groups(rows: DataFrame, offset: float = 0.0) -> DataFrame:
    """At most 97 rows: statistics per season and hour, both read after the shift to local time."""
    local = calendar.shift_hours(F.col("time"), offset)
    keys = {"season": calendar.season(F.month(local)), "hour": F.hour(local)}
    return periods.collect_groups(rows, keys, spread=True)


def hour_profile(groups: DataFrame) -> DataFrame:
    hours = merge_groups(periods.observed(groups, "hour"), "hour")
    return _complete(hours, calendar.hours(groups.sparkSession), "hour")


def season_hour_profile(groups: DataFrame) -> DataFrame:
    spark = groups.sparkSession
    cells = merge_groups(periods.observed(groups, "hour"), "season", "hour")
    dimension = calendar.seasons(spark).crossJoin(calendar.hours(spark))
    return _complete(cells, dimension, "season", "hour")


def season_peaks(groups: DataFrame) -> DataFrame:
    """Warmest and coolest hour of each observed season."""
    return (
        periods.observed(groups, "hour")
        .groupBy("season")
        .agg(
            periods.first_key_of_max("hour", "mean").alias("warmest_hour"),
            F.max("mean").alias("warmest_value"),
            periods.first_key_of_min("hour", "mean").alias("coolest_hour"),
            F.min("mean").alias("coolest_value"),
            (F.max("mean") - F.min("mean")).alias("diurnal_range"),
        )
    )


def _hour_summary(groups: DataFrame) -> DataFrame:
    hours = merge_groups(periods.observed(groups, "hour"), "hour")
    return hours.agg(
        (F.max("mean") - F.min("mean")).alias("diurnal_range"),
        periods.first_key_of_max("hour", "mean").alias("warmest_hour"),
        F.max("mean").alias("warmest_value"),
        periods.first_key_of_min("hour", "mean").alias("coolest_hour"),
        F.min("mean").alias("coolest_value"),
    )


def diurnal_cycle(
    df: DataFrame,
    time: str | None = None,
    target: str | None = None,
    roles: Roles | None = None,
    timezone_offset_hours: object = None,
    checked: bool = False,
) -> Result:
    """Hour-of-day statistics, overall and per season, from one scan into 96 groups."""
    roles = roles or Roles()
    time, target = time or roles.time, target or roles.target
    offset = option(timezone_offset_hours, fixed.HOUR_OFFSET)
    bundle = Bundle(checked)
    groups = bundle.hold(hour_groups(series(df, time, target), offset))
    bundle.require_coverage(groups, periods=False)
    bundle.require(lambda: groups.agg(F.count_distinct("hour").alias("n")), "n", fixed.MIN_HOURS, "distinct hours")
    return bundle.result(
        "diurnal_cycle",
        facts={
            "coverage": lambda: periods.coverage(groups).drop("missing_time", "missing_target"),
            "data_quality": lambda: _quality(groups, "hour", "observed_hours", "complete_24_hour_profile", 24),
            "summary": lambda: _hour_summary(groups),
        },
        records={
            "hourly_profile": lambda: hour_profile(groups),
            "seasonal_hourly_profile": lambda: season_hour_profile(groups),
            "seasonal_peaks": lambda: season_peaks(groups),
        },
        info={"time_column": time, "target_column": target, "timezone_offset_hours": offset},
    )
