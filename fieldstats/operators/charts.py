"""The data behind the five chart kinds: tables, no drawing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions import bins as binning
from fieldstats.functions.coerce import naive, number, numeric_columns, present, ref
from fieldstats.model import Roles
from fieldstats.operators.anomaly import is_anomaly, spread, value_rows, with_z_score
from fieldstats.operators.relate import correlation_pairs
from fieldstats.plans.ranks import systematic_sample
from fieldstats.plans.rowindex import with_row_index
from fieldstats.plans.series import clean, series


def time_series(
    df: DataFrame, time: str | None = None, value: str | None = None, roles: Roles | None = None
) -> DataFrame:
    """``(time, value)`` in time order, values rounded to 6 places. Equal times are ordered by value, which also spreads a
    crowded time over several tasks."""
    roles = roles or Roles()
    rows = clean(series(df, time or roles.time, value or roles.target))
    return rows.select(naive(F.col("time")).alias("time"), F.round("value", 6).alias("value")).orderBy("time", "value")


def scatter(
    df: DataFrame, x: str | None = None, y: str | None = None, cap: int | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """``(x, y)`` of the rows that have both; ``cap`` keeps that many, evenly spaced in ``order_by`` order."""
    numeric = numeric_columns(df)
    x = x or (numeric[0] if numeric else None)
    y = y or (numeric[1] if len(numeric) > 1 else None)
    if not x or not y:
        raise ValueError("Two numeric columns are needed.")
    pairs = df.where(present(df, x) & present(df, y)).select(
        number(df, x).alias("x"), number(df, y).alias("y"), *[ref(c).alias(f"k{i}") for i, c in enumerate(order_by)]
    )
    if cap is not None:
        pairs = systematic_sample(pairs, cap, [f"k{i}" for i in range(len(order_by))])
    return pairs.select("x", "y")


def spatial_grid(
    df: DataFrame,
    latitude: str,
    longitude: str,
    value: str,
    lat_bins: int = fixed.GRID_LAT_BINS,
    lon_bins: int = fixed.GRID_LON_BINS,
) -> DataFrame:
    """Mean value per cell of an equal-width grid; every cell is listed, empty ones with 0.

    The bounds are one aggregate row, broadcast. Rows find their cell by arithmetic and are combined before the
    shuffle, so a crowded cell stays cheap and at most ``lat_bins * lon_bins`` groups exist.
    """
    points = df.select(
        number(df, latitude).alias("lat"), number(df, longitude).alias("lon"), number(df, value).alias("v")
    ).dropna()
    lat_low, lat_high = binning.widen_cut(F.min("lat"), F.max("lat"))
    lon_low, lon_high = binning.widen_cut(F.min("lon"), F.max("lon"))
    bounds = points.agg(
        lat_low.alias("lat_low"), lat_high.alias("lat_high"), lon_low.alias("lon_low"), lon_high.alias("lon_high")
    )
    located = points.crossJoin(F.broadcast(bounds))
    cells = located.select(
        binning.right_closed(F.col("lat"), F.col("lat_low"), F.col("lat_high"), lat_bins).alias("lat_bin"),
        binning.right_closed(F.col("lon"), F.col("lon_low"), F.col("lon_high"), lon_bins).alias("lon_bin"),
        "v",
    )
    means = cells.groupBy("lat_bin", "lon_bin").agg(F.avg("v").alias("value"))
    # Cells are numbered, so a fine grid is as many rows of a range, and no side of the join is sent to all tasks unless it is small.
    number_of = F.col("id")
    grid = df.sparkSession.range(lat_bins * lon_bins).select(
        F.floor(number_of / lon_bins).cast("int").alias("lat_bin"), (number_of % lon_bins).cast("int").alias("lon_bin")
    )
    return grid.join(means, ["lat_bin", "lon_bin"], "left").fillna(0.0, subset=["value"])


def grid_matrix(grid: DataFrame, lon_bins: int = fixed.GRID_LON_BINS) -> DataFrame:
    """The grid with one row per latitude bin and one column per longitude bin."""
    columns = list(range(lon_bins))
    return grid.groupBy("lat_bin").pivot("lon_bin", columns).agg(F.first("value"))


def grid_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """The intervals (left, right] of one axis; the first is opened by 0.1 % so that it holds the minimum."""
    values = df.select(number(df, column).alias("v"))
    low, high = binning.widen_cut(F.min("v"), F.max("v"))
    bounds = values.agg(low.alias("low"), high.alias("high"), F.min("v").alias("first"), F.max("v").alias("last"))
    listed = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    left = binning.edge(F.col("bin"), F.col("low"), F.col("high"), bins)
    opened = F.when(
        (F.col("bin") == 0) & (F.col("first") < F.col("last")), left - (F.col("high") - F.col("low")) * 0.001
    ).otherwise(left)
    right = binning.edge(F.col("bin") + 1, F.col("low"), F.col("high"), bins)
    return listed.select("bin", opened.alias("left"), right.alias("right"))


def heatmap(
    df: DataFrame,
    value: str | None = None,
    roles: Roles | None = None,
    lat_bins: int = fixed.GRID_LAT_BINS,
    lon_bins: int = fixed.GRID_LON_BINS,
) -> DataFrame:
    """The spatial grid when place and value are known, else the correlation of all numeric columns."""
    roles = roles or Roles()
    value = value or roles.target
    if roles.latitude and roles.longitude and value and value in df.columns:
        return spatial_grid(df, roles.latitude, roles.longitude, value, lat_bins, lon_bins)
    columns = numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("Either place and value, or two numeric columns, are needed.")
    return correlation_pairs(df, columns).fillna(0.0, subset=["r"])


def map_points(
    df: DataFrame,
    latitude: str | None = None,
    longitude: str | None = None,
    value: str | None = None,
    roles: Roles | None = None,
    max_points: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """``(lat, lon, value)`` of complete rows: all, or at most ``max_points`` of them, evenly spaced."""
    roles = roles or Roles()
    latitude, longitude = latitude or roles.latitude, longitude or roles.longitude
    value = value or roles.target
    if not latitude or not longitude:
        raise ValueError("Latitude and longitude columns are needed.")
    columns = [latitude, longitude, *([value] if value and value in df.columns else [])]
    complete = df
    for c in columns:
        complete = complete.where(present(df, c))
    points = complete.select(
        number(df, latitude).alias("lat"),
        number(df, longitude).alias("lon"),
        *([F.round(F.coalesce(number(df, value), F.lit(0.0)), 6).alias("value")] if len(columns) == 3 else []),
        *[ref(c).alias(f"k{i}") for i, c in enumerate(order_by)],
    )
    keys = [f"k{i}" for i in range(len(order_by))]
    if max_points is not None:
        points = systematic_sample(points, max_points, keys)
    return points.drop(*keys)


def anomaly_graph(
    df: DataFrame,
    value: str | None = None,
    time: str | None = None,
    roles: Roles | None = None,
    z_threshold: float = fixed.Z_THRESHOLD,
) -> DataFrame:
    """Every point, rounded to 6 places, flagged when it is anomalous; values that are all equal raise. Without a time, ``x`` is the row number."""
    roles = roles or Roles()
    value, time = value or roles.target, time or roles.time
    if not value or value not in df.columns:
        raise ValueError("A numeric value column is needed.")
    time = time if time in df.columns else None
    if time:
        rows = value_rows(df, value, time).select(F.col("time").alias("x"), "value")
    else:
        rows = with_row_index(value_rows(df, value), (), "x")
    facts = spread(rows).head()
    if not facts["std"]:
        raise ValueError("The values are all equal or missing, so none can be an anomaly.")
    z = (F.col("value") - F.lit(facts["mean"])) / F.lit(facts["std"])
    return rows.select("x", F.round("value", 6).alias("value"), F.coalesce(is_anomaly(z, z_threshold), F.lit(False)).alias("is_anomaly"))
