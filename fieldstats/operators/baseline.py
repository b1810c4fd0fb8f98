"""Anomalies against the monthly means of a baseline period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions import calendar
from fieldstats.model import Result, Roles
from fieldstats.operators.common import Bundle
from fieldstats.plans import periods
from fieldstats.plans.series import series


def mark_baseline(days: DataFrame, start: str | None, end: str | None, normal: bool = False) -> DataFrame:
    """Adds ``in_baseline`` and ``requested`` to a period table.

    Period labels from ``start`` to ``end``, both included, form the baseline. When no period matches, all periods
    do, and ``requested`` is false. With ``normal`` and no dates, 1991-2020 is used if the data cover it. All of it
    is decided by windows over the (calendar-bounded) period table, so nothing is read twice.
    """
    label = F.col("period").cast("timestamp")

    def moment(text: str) -> Column:
        return F.lit(str(text)).try_cast("timestamp")

    asked = bool(start or end)
    if asked:
        inside = F.lit(True)
        if start:
            inside = inside & F.coalesce(label >= moment(start), F.lit(False))
        if end:
            inside = inside & F.coalesce(label <= moment(end), F.lit(False))
        wanted = F.lit(True)
    elif normal:
        first, last = moment(fixed.NORMAL_START), moment(fixed.NORMAL_END)
        wanted = (F.min("first_time").over(periods.whole()) <= first) & (F.max("last_time").over(periods.whole()) >= last)
        inside = label.between(first, last)
    else:
        return days.withColumns({"in_baseline": F.lit(True), "requested": F.lit(False)})
    staged = days.withColumns({"__inside": inside, "__wanted": wanted})
    hits = F.count_if("__inside").over(periods.whole())
    staged = staged.withColumn("requested", F.col("__wanted") & (hits > 0))
    return staged.withColumn("in_baseline", F.when(F.col("requested"), F.col("__inside")).otherwise(True)).drop(
        "__inside", "__wanted"
    )


def month_baseline(marked: DataFrame) -> DataFrame:
    """All 12 months with the mean of their baseline periods; NULL where the baseline has none."""
    used = (
        marked.where("in_baseline")
        .groupBy(F.month("period").alias("month"))
        .agg(F.avg("mean").alias("baseline"))
    )
    return (
        calendar.months(marked.sparkSession)
        .join(F.broadcast(used), "month", "left")
        .select("month", calendar.month_label(F.col("month")).alias("month_label"), "baseline")
    )


def baseline_facts(marked: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    months = F.count_distinct(F.month("period"))
    return marked.where("in_baseline").agg(
        periods.midnight(F.min("period")).alias("start"),
        periods.midnight(F.max("period")).alias("end"),
        F.lit(start).cast("string").alias("requested_start"),
        F.lit(end).cast("string").alias("requested_end"),
        F.bool_or("requested").alias("used_requested_period"),
        F.count(F.lit(1)).alias("periods"),
        F.avg("mean").alias("mean"),
        months.alias("observed_months"),
        (months == 12).alias("complete_12_month_profile"),
    )


def period_anomalies(marked: DataFrame) -> DataFrame:
    """Each period's mean minus the baseline of its month: the month's baseline is a window over its own periods."""
    same_month = Window.partitionBy(F.month("period"))
    usual = F.when(F.col("in_baseline"), F.col("mean"))
    return marked.withColumns(
        {"anomaly": F.col("mean") - F.avg(usual).over(same_month), "baseline_mean": F.avg(usual).over(periods.whole())}
    )


def annual_anomalies(marked: DataFrame) -> DataFrame:
    """Statistics of the anomalies of each year; periods of months outside the baseline are left out."""
    return _years(marked).drop("baseline_mean")


def _years(marked: DataFrame) -> DataFrame:
    return (
        period_anomalies(marked)
        .where(F.col("anomaly").isNotNull())
        .groupBy(F.year("period").alias("year"))
        .agg(
            F.avg("anomaly").alias("anomaly"),
            F.stddev_samp("anomaly").alias("std"),
            F.min("anomaly").alias("min"),
            F.max("anomaly").alias("max"),
            F.count("anomaly").alias("count"),
            F.max("baseline_mean").alias("baseline_mean"),
        )
    )


def anomaly_summary(years: DataFrame) -> DataFrame:
    return years.agg(
        F.max("baseline_mean").alias("baseline_mean"),
        periods.first_key_of_min("year", "anomaly").alias("most_negative_year"),
        F.min("anomaly").alias("most_negative_anomaly"),
        periods.first_key_of_max("year", "anomaly").alias("most_positive_year"),
        F.max("anomaly").alias("most_positive_anomaly"),
        F.count_if(F.col("anomaly") < 0).alias("negative_years"),
        F.count_if(F.col("anomaly") >= 0).alias("positive_years"),
    )


def baseline_anomalies(
    df: DataFrame,
    time: str | None = None,
    target: str | None = None,
    roles: Roles | None = None,
    baseline_start: str | None = None,
    baseline_end: str | None = None,
    checked: bool = False,
) -> Result:
    roles = roles or Roles()
    time, target = time or roles.time, target or roles.target
    bundle = Bundle(checked)
    groups = bundle.hold(periods.period_groups(series(df, time, target), "D"))
    bundle.require_coverage(groups)
    marked = mark_baseline(periods.observed(groups), baseline_start, baseline_end, normal=True)

    def baseline() -> DataFrame:
        facts = baseline_facts(marked, baseline_start, baseline_end)
        if baseline_start or baseline_end:
            return facts
        # Without dates, the normal counts as requested whenever it was used.
        for name, text in (("requested_start", fixed.NORMAL_START), ("requested_end", fixed.NORMAL_END)):
            facts = facts.withColumn(name, F.when(F.col("used_requested_period"), text))
        return facts

    def summary() -> DataFrame:
        return anomaly_summary(_years(marked))

    return bundle.result(
        "baseline_anomalies",
        facts={
            "coverage": lambda: periods.coverage(
                groups, "daily_periods", annual_periods=F.count_distinct(F.year("period"))
            ),
            "baseline": baseline,
            "summary": summary,
        },
        records={
            "monthly_baseline": lambda: month_baseline(marked),
            "annual_anomalies": lambda: annual_anomalies(marked),
        },
        info={"time_column": time, "target_column": target},
    )
