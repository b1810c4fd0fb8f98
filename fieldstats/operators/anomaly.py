"""Rows far from the mean, in population standard deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.coerce import naive, number, ref, text_columns, timestamp
from fieldstats.model import Result, Roles
from fieldstats.operators.common import Bundle
from fieldstats.session import use_utc


def value_rows(df: DataFrame, target: str, time: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a usable value: ``value``, ``time`` (when there is one) and the columns to keep."""
    use_utc(df.sparkSession)
    columns = [number(df, target).alias("value")]
    if time:
        columns.append(naive(timestamp(df, time)).alias("time"))
        if time in text_columns(df):
            columns.append(ref(time).alias("time_text"))
    return df.select(*columns, *[ref(c) for c in keep]).where(F.col("value").isNotNull())


def spread(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("rows")
    )


def with_z_score(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The one-row mean and deviation are broadcast; the rows stay where they are."""
    moments = facts.select(F.col("mean").alias("__mean"), F.col("std").alias("__std"))
    z = F.try_divide(F.col("value") - F.col("__mean"), F.col("__std"))
    return rows.crossJoin(F.broadcast(moments)).withColumn("z_score", z).drop("__mean", "__std")


def is_anomaly(z: Column, threshold: float) -> Column:
    return F.abs(z) >= F.lit(float(threshold))


def anomaly_rows(
    df: DataFrame,
    target: str,
    time: str | None = None,
    z_threshold: float = fixed.Z_THRESHOLD,
    keep: Sequence[str] = (),
    facts: DataFrame | None = None,
) -> DataFrame:
    """Every anomalous row, in no order."""
    rows = value_rows(df, target, time, keep)
    scored = with_z_score(rows, spread(rows) if facts is None else facts)
    return scored.where(is_anomaly(F.col("z_score"), z_threshold))


def anomaly_detection(
    df: DataFrame,
    target: str | None = None,
    time: str | None = None,
    roles: Roles | None = None,
    z_threshold: float = fixed.Z_THRESHOLD,
    order_by: Sequence[str] = (),
    limit: int | None = None,
    checked: bool = False,
) -> Result:
    """``anomalies`` lists the anomalous rows, with a ``limit`` the first of them in ``order_by`` order (of time and value without
    one, never that of files); ``summary`` counts all of them, and ``all_anomalies`` holds all of them."""
    roles = roles or Roles()
    time, target = time or roles.time, target or roles.target
    if not target:
        raise ValueError("A numeric target column is needed. Name one or set the variable roles.")
    z_threshold = float(z_threshold)
    rows = value_rows(df, target, time, order_by)
    bundle = Bundle(checked)
    facts = bundle.hold(spread(rows))
    bundle.require(facts, "rows", fixed.MIN_ROWS, "numeric rows")
    if checked and facts.head()["std"] == 0:
        bundle.fail("The standard deviation is zero, so no row can be an anomaly.")

    def found() -> DataFrame:
        return anomaly_rows(df, target, time, z_threshold, order_by, facts)

    def summary() -> DataFrame:
        z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
        return rows.crossJoin(F.broadcast(facts.select("mean", "std"))).agg(
            F.lit(z_threshold).alias("z_threshold"),
            F.max("mean").alias("mean"),
            F.max("std").alias("std"),
            F.count_if(is_anomaly(z, z_threshold)).alias("anomaly_count"),
        )

    def listing() -> DataFrame:
        table = found()
        if limit is not None:
            order = list(order_by) or [c for c in ("time", "time_text", "value") if c in table.columns]
            table = table.orderBy(*[ref(c) for c in order]).limit(limit)
        shown = ["time"] if "time" in table.columns else []
        if "time_text" in table.columns:
            # A text time that cannot be read is shown as it is.
            iso = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")
            table = table.withColumn("time", F.coalesce(iso, "time_text"))
        return table.select(*shown, "value", "z_score", *[ref(c) for c in order_by])

    return bundle.result(
        "anomaly_detection",
        facts={"coverage": summary},
        records={"anomalies": listing, "all_anomalies": found},
        info={"target_column": target},
    )
