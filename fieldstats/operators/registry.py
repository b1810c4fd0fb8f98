"""Choosing an analysis or a chart by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from fieldstats.model import Result, Roles
from fieldstats.operators import charts
from fieldstats.operators.anomaly import anomaly_detection
from fieldstats.operators.baseline import baseline_anomalies
from fieldstats.operators.climatology import diurnal_cycle, seasonal_patterns
from fieldstats.operators.describe import descriptive_stats
from fieldstats.operators.distribution import decadal_distributions
from fieldstats.operators.extremes import extreme_events
from fieldstats.operators.forecast import time_series_forecasting
from fieldstats.operators.models import linear_regression, random_forest_regression
from fieldstats.operators.relate import correlation
from fieldstats.operators.trend import annual_trend_signal, trend_detection
from fieldstats.operators.workflow import climate_workflow

# Analyses over one series: time column, target column, and whether they share a persisted small table.
_SERIES = {
    "seasonal_patterns": seasonal_patterns,
    "diurnal_cycle": diurnal_cycle,
    "annual_trend_signal": annual_trend_signal,
    "baseline_anomalies": baseline_anomalies,
    "extreme_events": extreme_events,
    "decadal_distributions": decadal_distributions,
    "anomaly_detection": anomaly_detection,
    "climate_workflow": climate_workflow,
}
_TRENDS = ("trend_detection", "temperature_trend", "precipitation_trend")
_COLUMNS = {"descriptive_stats": descriptive_stats, "correlation": correlation}
_MODELS = {"linear_regression": linear_regression, "random_forest_regression": random_forest_regression}

ANALYSES = (*_COLUMNS, *_TRENDS, *_MODELS, *_SERIES, "time_series_forecasting")
CHARTS = {
    "time_series": charts.time_series,
    "scatter": charts.scatter,
    "heatmap": charts.heatmap,
    "map": charts.map_points,
    "anomaly_graph": charts.anomaly_graph,
}


def analyze(
    df: DataFrame,
    kind: str,
    roles: Roles | None = None,
    target: str | None = None,
    features: Sequence[str] | None = None,
    time: str | None = None,
    checked: bool = False,
    **options: object,
) -> Result:
    """Run one of ``ANALYSES``; what is not named comes from the roles."""
    if kind in _COLUMNS:
        return _COLUMNS[kind](df, features, roles, **options)
    if kind in _TRENDS:
        return trend_detection(df, time, target, roles, kind, checked=checked)
    if kind in _MODELS:
        return _MODELS[kind](df, target, features, roles, **options)
    if kind in _SERIES:
        return _SERIES[kind](df, time=time, target=target, roles=roles, checked=checked, **options)
    if kind == "time_series_forecasting":
        return time_series_forecasting(df, time, target, roles, **options)
    raise ValueError(f"Unknown analysis '{kind}'. Known: {', '.join(ANALYSES)}")


def chart(df: DataFrame, kind: str, roles: Roles | None = None, **options: object) -> DataFrame:
    """Data of one of ``CHARTS``."""
    if kind not in CHARTS:
        raise ValueError(f"Unknown chart '{kind}'. Known: {', '.join(CHARTS)}")
    if kind != "scatter":
        options["roles"] = roles
    return CHARTS[kind](df, **options)
