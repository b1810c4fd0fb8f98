"""The combined workflow: one period table, every climate summary on top of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.calendar import decade, frequency, season, season_order
from fieldstats.functions.options import option
from fieldstats.model import Result, Roles
from fieldstats.operators.baseline import baseline_facts, mark_baseline, month_baseline, period_anomalies
from fieldstats.operators.common import Bundle
from fieldstats.operators.describe import describe_table
from fieldstats.operators.extremes import limits_and_counts, year_counts
from fieldstats.operators.trend import year_summary, yearly_means
from fieldstats.plans import periods
from fieldstats.plans.ranks import takes_row
from fieldstats.plans.series import clean, series


def month_summary(table: DataFrame) -> DataFrame:
    """Observed months only, over period means."""
    return table.groupBy(F.month("period").alias("month")).agg(
        F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"), F.count("mean").alias("count")
    )


def season_summary(table: DataFrame) -> DataFrame:
    stats = table.groupBy(season(F.month("period")).alias("season")).agg(
        F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"), F.count("mean").alias("count")
    )
    return stats.orderBy(season_order(F.col("season")))


def year_anomalies(marked: DataFrame) -> DataFrame:
    """Years keep their row even when no month of theirs has a baseline."""
    return period_anomalies(marked).groupBy(F.year("period").alias("year")).agg(F.avg("anomaly").alias("anomaly"))


def decade_summary(table: DataFrame) -> DataFrame:
    return table.groupBy(decade(F.year("period")).alias("decade")).agg(
        F.avg("mean").alias("mean"),
        F.stddev_samp("mean").alias("std"),
        F.min("mean").alias("min"),
        F.max("mean").alias("max"),
        F.count("mean").alias("count"),
    )


def period_preview(table: DataFrame, size: int | None = None) -> DataFrame:
    """All periods, or at most ``size`` of them, evenly spaced. The table is calendar-bounded, so a plain row number is enough."""
    numbered = table.select(
        "*",
        (F.row_number().over(Window.orderBy("period")) - 1).alias("__row"),
        F.count(F.lit(1)).over(periods.whole()).alias("__total"),
    )
    taken = F.lit(True)
    if size is not None:
        taken = (F.col("__total") <= size) | takes_row(F.col("__row"), F.col("__total"), size)
    return numbered.where(taken).select(
        periods.midnight(F.col("period")).alias("time"),
        "mean",
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        "count",
    )


def climate_workflow(
    df: DataFrame,
    time: str | None = None,
    target: str | None = None,
    roles: Roles | None = None,
    aggregation_frequency: str = "D",
    baseline_start: str | None = None,
    baseline_end: str | None = None,
    high_quantile: object = None,
    low_quantile: object = None,
    checked: bool = False,
    preview_rows: int | None = None,
) -> Result:
    roles = roles or Roles()
    time, target = time or roles.time, target or roles.target
    code = frequency(aggregation_frequency)
    high = option(high_quantile, fixed.HIGH_QUANTILE)
    low = option(low_quantile, fixed.LOW_QUANTILE)
    rows = series(df, time, target)
    bundle = Bundle(checked)
    groups = bundle.hold(periods.period_groups(rows, code))
    bundle.require_coverage(groups)
    table = periods.observed(groups)
    marked = mark_baseline(table, baseline_start, baseline_end)
    limits = ["high_quantile", "low_quantile", "high_threshold", "low_threshold"]
    counts = ["high_trend_per_decade", "low_trend_per_decade"]

    def summary() -> DataFrame:
        stats = describe_table(clean(rows), ["value"])
        return stats.select(
            "count", "mean", "std", "min", F.col("25%").alias("q25"), F.col("50%").alias("median"),
            F.col("75%").alias("q75"), "max",
        )

    def extremes() -> DataFrame:
        return limits_and_counts(table, high, low).select(*limits, *counts)

    return bundle.result(
        "climate_workflow",
        facts={
            "coverage": lambda: periods.coverage(groups, "aggregated_periods"),
            "summary": summary,
            "annual_trend": lambda: year_summary(yearly_means(table)),
            "baseline": lambda: baseline_facts(marked, baseline_start, baseline_end),
            "extremes": extremes,
        },
        records={
            "monthly_climatology": lambda: month_summary(table),
            "seasonal_cycle": lambda: season_summary(table),
            "annual_points": lambda: yearly_means(table).select("year", "mean"),
            "baseline_months": lambda: month_baseline(marked),
            "annual_anomalies": lambda: year_anomalies(marked),
            "extremes_per_year": lambda: year_counts(table, high, low).select(
                "year", F.col("high_days").alias("high_count"), F.col("low_days").alias("low_count")
            ),
            "decadal_distribution": lambda: decade_summary(table),
            "aggregated_preview": lambda: period_preview(table, preview_rows),
        },
        info={"time_column": time, "target_column": target, "aggregation_frequency": code},
    )
