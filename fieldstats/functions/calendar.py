"""Period labels, seasons and calendar dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats import fixed


def frequency(name: str) -> str:
    code = fixed.FREQUENCY_NAMES.get(str(name).strip().upper())
    if code is None:
        raise ValueError(f"Unknown frequency '{name}'. Use D, ME or YE.")
    return code


def period_date(time: Column, code: str) -> Column:
    """The period a time falls in, as a date: the day, the last day of the month, or 31 December."""
    if code == "D":
        return F.to_date(time)
    if code == "ME":
        return F.last_day(time)
    return F.make_date(F.year(time), F.lit(12), F.lit(31))


def season(month: Column) -> Column:
    expr = None
    for name in fixed.SEASONS:
        member = month.isin(*fixed.SEASON_MONTHS[name])
        expr = F.when(member, name) if expr is None else expr.when(member, name)
    return expr


def season_order(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEASONS]), name).cast("int")


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in fixed.MONTH_LABELS]), month.cast("int"))


def decade(year: Column) -> Column:
    return (F.floor(year / F.lit(10)) * 10).cast("int")


def decade_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("s"))


def shift_hours(time: Column, hours: float) -> Column:
    """Fractional hour shift, exact to the microsecond."""
    return F.timestamp_micros(F.unix_micros(time) + F.lit(round(hours * 3_600_000_000)))


def months(spark: SparkSession) -> DataFrame:
    return spark.range(1, 13, 1, 1).select(F.col("id").cast("int").alias("month"))


def seasons(spark: SparkSession) -> DataFrame:
    names = F.array(*[F.lit(s) for s in fixed.SEASONS])
    return spark.range(0, 4, 1, 1).select(F.get(names, F.col("id").cast("int")).alias("season"))


def hours(spark: SparkSession) -> DataFrame:
    return spark.range(0, 24, 1, 1).select(F.col("id").cast("int").alias("hour"))


def periods_from(period: Column, following: Column, code: str) -> Column:
    """Array of the period labels from ``period`` up to, not including, the label ``following`` (NULL: just itself)."""
    if code == "D":
        return F.sequence(period, F.coalesce(F.date_sub(following, 1), period))
    if code == "ME":
        # Step over month starts: stepping from a month end drifts (29 Feb + 1 month = 29 Mar).
        start = F.trunc(period, "month")
        last = F.coalesce(F.add_months(F.trunc(following, "month"), -1), start)
        return F.transform(F.sequence(start, last, F.expr("interval 1 month")), F.last_day)
    last = F.coalesce(F.year(following) - 1, F.year(period))
    return F.transform(F.sequence(F.year(period), last), lambda y: F.make_date(y, F.lit(12), F.lit(31)))
