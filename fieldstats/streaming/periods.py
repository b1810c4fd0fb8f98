"""Daily aggregation of a stream, with late rows bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.coerce import number, time_expr, field_type, ref
from fieldstats.operators.aggregate import aggregate_columns, check_aggregations
from fieldstats.session import use_utc


def stream_daily_aggregation(
    stream: DataFrame,
    time: str,
    columns: Sequence[str],
    aggregations: Sequence[str] = fixed.DEFAULT_AGGREGATIONS,
    lateness: str = "1 day",
    pattern: str | None = None,
) -> DataFrame:
    """The daily form of ``temporal_aggregation`` for ``writeStream``.

    State is one row per open day. In append mode a day is emitted once the watermark has passed its end. Days
    without rows are not listed.
    """
    use_utc(stream.sparkSession)
    aggregations = check_aggregations(aggregations)
    rows = stream.select(
        time_expr(ref(time), field_type(stream, time), pattern).alias("__time"),
        *[number(stream, c).alias(c) for c in columns],
    ).where(F.col("__time").isNotNull())
    days = (
        rows.withWatermark("__time", lateness)
        .groupBy(F.window("__time", "1 day"))
        .agg(*aggregate_columns(columns, aggregations))
    )
    outputs = [f"{c}_{a}" for a in aggregations for c in columns]
    return days.select(
        F.col("window.start").cast("timestamp_ntz").alias("period_start"), *[F.col(f"`{c}`") for c in outputs]
    )
