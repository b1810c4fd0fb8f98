"""Short forecasts from a linear autoregression."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.coerce import naive, number, ref, timestamp
from fieldstats.model import Result, Roles
from fieldstats.plans import gram
from fieldstats.plans.halo import lagged
from fieldstats.plans.rowindex import number_rows
from fieldstats.plans.series import clean, series
from fieldstats.session import use_utc


@dataclass(frozen=True)
class Spacing:
    """How the times of a series follow each other, over all its rows."""

    rows: int
    gap: timedelta | None  # if all gaps are equal
    months: int | None  # between neighbours, if equal everywhere and the clock time is too
    month_starts: bool
    month_ends: bool
    weekdays: bool  # every weekday once, at one clock time
    increasing: bool


def spacing(indexed: DataFrame, block_rows: int | None = None) -> Spacing:
    """One aggregate row over each time and the one before it; ``indexed`` has ``row_index`` and ``time``."""
    moments = indexed.select("row_index", naive(F.col("time")).alias("t"))
    pairs = lagged(moments, "t", 1, block_rows=block_rows)
    t, before = F.col("t"), F.col("lag_1")
    micros = F.unix_micros(t.cast("timestamp"))
    gap = micros - F.unix_micros(before.cast("timestamp"))
    clock = F.pmod(micros, F.lit(86_400_000_000))
    months = (F.year(t) - F.year(before)) * 12 + F.month(t) - F.month(before)
    jump = F.floor(gap / F.lit(86_400_000_000)) == F.when(F.weekday(before) == 4, 3).otherwise(1)
    row = pairs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(gap).alias("least"),
        F.max(gap).alias("most"),
        (F.min(clock) == F.max(clock)).alias("one_clock"),
        F.min(months).alias("fewest"),
        F.max(months).alias("months"),
        F.bool_and(F.dayofmonth(t) == 1).alias("starts"),
        F.bool_and(F.to_date(t) == F.last_day(t)).alias("ends"),
        F.bool_and((F.weekday(t) < 5) & F.coalesce(jump, F.lit(True))).alias("weekdays"),
    ).head()
    even = row["least"] is not None and row["least"] == row["most"]
    whole = bool(row["one_clock"]) and row["fewest"] == row["months"] and bool(row["months"])
    return Spacing(
        row["rows"],
        timedelta(microseconds=row["least"]) if even else None,
        row["months"] if whole else None,
        bool(row["starts"]),
        bool(row["ends"]),
        bool(row["one_clock"] and row["weekdays"] and not even),
        row["least"] is not None and row["least"] > 0,
    )


def time_series_forecasting(
    df: DataFrame,
    time: str | None = None,
    target: str | None = None,
    roles: Roles | None = None,
    lags: int = fixed.FORECAST_LAGS,
    horizon: int = fixed.FORECAST_HORIZON,
    order_by: Sequence[str] = (),
    block_rows: int | None = None,
) -> Result:
    """Regression of each value on the ``lags`` rows before it, run forward ``horizon`` steps.

    Rows are numbered in time order and lagged in overlapping blocks; the fit is one aggregate row. Only the last
    ``lags`` values, one row of sums and one about the spacing reach the driver.
    """
    roles = roles or Roles()
    time, target = time or roles.time, target or roles.target
    lags, horizon = int(lags), int(horizon)
    rows = series(df, time, target) if not order_by else _keyed_series(df, time, target, order_by)
    keys = [f"k{i}" for i in range(len(order_by))]
    indexed, total = number_rows(clean(rows), ["time", *keys], "row_index")
    indexed = indexed.select("row_index", "time", "value")
    if total <= lags + fixed.FORECAST_EXTRA_ROWS:
        raise ValueError(f"More than {lags + fixed.FORECAST_EXTRA_ROWS} rows are needed, found {total}.")
    names = [f"lag_{k}" for k in range(1, lags + 1)]
    ends = indexed.where(F.col("row_index") >= total - max(lags, 1))
    known = sorted(ends.select("row_index", naive(F.col("time")).alias("time"), "value").collect())
    mean = gram.centres(indexed, ["value"])["value"]
    centre = dict.fromkeys([*names, "value"], mean)
    history = lagged(indexed, "value", lags, block_rows=block_rows).dropna(subset=names)
    model = gram.fit(history, names, "value", centre)
    recent = [r["value"] for r in known[::-1][:lags]]  # newest first
    steps: list[float] = []
    for _ in range(horizon):
        following = model.intercept + sum(w * v for w, v in zip(model.coefficients, recent))
        steps.append(following)
        recent = [following, *recent][:lags] if lags else recent
    future = extend_times(spacing(indexed, block_rows), known[-1]["time"], horizon)
    spark = df.sparkSession

    def forecast() -> DataFrame:
        if future is None:
            return spark.createDataFrame(list(enumerate(steps, 1)), "step int, forecast double")
        return spark.createDataFrame(list(zip(future, steps)), "time timestamp_ntz, forecast double")

    weights = list(zip(names, model.coefficients))
    return Result(
        "time_series_forecasting",
        facts={
            "coverage": lambda: spark.createDataFrame(
                [(lags, horizon, model.intercept)], "lags int, horizon int, model_intercept double"
            )
        },
        records={
            "forecast": forecast,
            "model_coefficients": lambda: spark.createDataFrame(weights, "lag string, coefficient double"),
        },
        info={"time_column": time, "target_column": target},
    )


def _keyed_series(df: DataFrame, time: str, target: str, order_by: Sequence[str]) -> DataFrame:
    """The series with tie-breaking keys for rows of the same time."""
    use_utc(df.sparkSession)
    keys = [ref(c).alias(f"k{i}") for i, c in enumerate(order_by)]
    return df.select(timestamp(df, time).alias("time"), number(df, target).alias("value"), *keys)


def _add_months(t: datetime, months: int, at_end: bool) -> datetime:
    year, month = divmod(t.year * 12 + t.month - 1 + months, 12)
    day = calendar.monthrange(year, month + 1)[1] if at_end else 1
    return t.replace(year=year, month=month + 1, day=day)


def extend_times(seen: Spacing, last: datetime, steps: int) -> list[datetime] | None:
    """``steps`` times after ``last`` at the spacing of the series; NULL when it has no regular one.

    Whole months, quarters and years are stepped on the calendar, weekdays skip weekends, anything else needs one
    constant gap.
    """
    if seen.rows < 3 or not seen.increasing:
        return None
    if seen.months and (seen.month_starts or seen.month_ends):
        return [_add_months(last, seen.months * k, not seen.month_starts) for k in range(1, steps + 1)]
    if seen.weekdays:
        days = (last + timedelta(days=k) for k in range(1, 2 * steps + 8))
        return [d for d in days if d.weekday() < 5][:steps]
    if seen.gap is not None:
        return [last + seen.gap * k for k in range(1, steps + 1)]
    return None
