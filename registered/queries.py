"""Registered queries: each runs one operator over whole tables and returns its result table.

Doubles are rounded so that another engine, summing in another order, gives the same digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats import Dataset, Roles, list_datasets
from fieldstats.functions.coerce import number
from fieldstats.operators import aggregate, anomaly, baseline, charts, climatology, describe, distribution, extremes
from fieldstats.operators import forecast, models, recipes, relate, roles, trend, workflow
from fieldstats.plans.ranks import systematic_sample
from fieldstats.plans.halo import lagged
from fieldstats.plans.rowindex import number_rows
from fieldstats.session import ensure_checkpoint_dir, use_utc
from fieldstats.sources.flatten import flatten_grid, flatten_raster
from fieldstats.sources.readers import read_table
from fieldstats.sources.sinks import export_result, export_tables, write_csv, write_parquet
from fieldstats.sources.standardize import standardize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

ORDERS = ("o_orderdate", "o_totalprice")
EVENTS = ("ts", "value")
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Digits of means of cents: a tie there would take a count that 64 divides.
MEAN_DIGITS = 7
BASELINE = {"baseline_start": "1996-01-01", "baseline_end": "1998-12-31"}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    return df.select(
        *[
            F.round(c, special.get(c, digits)).alias(c) if kind == "double" else F.col(f"`{c}`")
            for c, kind in df.dtypes
        ]
    )


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write and read."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- trends over years and over time points ---------------------------------------------------------------


@query
def annual_trend_signal(spark, d):
    return rounded(trend.annual_trend_signal(table(spark, d, "orders"), *ORDERS)["annual_series"])


@query
def annual_trend_summary(spark, d):
    return rounded(trend.annual_trend_signal(table(spark, d, "orders"), *ORDERS)["summary"], r2=6)


@query
def annual_trend_coverage(spark, d):
    return trend.annual_trend_signal(table(spark, d, "orders"), *ORDERS)["coverage"]


@query
def trend_fit(spark, d):
    fit = trend.trend_detection(table(spark, d, "events"), *EVENTS)["fit"]
    per_day = F.col("slope_per_second") * 86400
    return fit.select(
        "rows",
        F.round(per_day, 6).alias("slope_per_day"),
        F.round("intercept", 3).alias("intercept"),
        F.round("r2", 9).alias("r2"),
        "trend_direction",
    )


@query
def trend_points(spark, d):
    return rounded(trend.trend_detection(table(spark, d, "events"), *EVENTS)["points"], 4)


@query
def temperature_trend_pick(spark, d):
    events = table(spark, d, "events")
    warmed = events.select("ts", "user_id", F.col("value").alias("air_temp"))
    known = Roles(time="ts", variables=("user_id", "air_temp"))
    result = trend.trend_detection(warmed, roles=known, kind="temperature_trend")
    return result["fit"].select(
        F.lit(result.info["target_column"]).alias("target_column"),
        F.round(F.col("slope_per_second") * 86400, 6).alias("slope_per_day"),
        F.round("r2", 9).alias("r2"),
    )


@query
def precipitation_trend_pick(spark, d):
    items = table(spark, d, "lineitem").select(
        "l_shipdate", "l_quantity", F.col("l_extendedprice").alias("rainfall")
    )
    known = Roles(time="l_shipdate", variables=("l_quantity", "rainfall"))
    result = trend.trend_detection(items, roles=known, kind="precipitation_trend")
    return result["fit"].select(
        F.lit(result.info["target_column"]).alias("target_column"),
        F.round(F.col("slope_per_second") * 86400, 6).alias("slope_per_day"),
        F.round("r2", 9).alias("r2"),
    )


# --- resampling to periods ----------------------------------------------------------------------------------


@query
def temporal_agg_daily(spark, d):
    days = aggregate.temporal_aggregation(
        table(spark, d, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice"], "daily",
        ["mean", "min", "max", "range"],
    )
    return rounded(days, l_quantity_mean=MEAN_DIGITS, l_extendedprice_mean=MEAN_DIGITS)


@query
def temporal_agg_monthly(spark, d):
    return rounded(
        aggregate.temporal_aggregation(
            table(spark, d, "orders"), "o_orderdate", ["o_totalprice"], "month", ["mean", "std", "max", "range"]
        )
    )


@query
def temporal_agg_yearly(spark, d):
    return rounded(
        aggregate.temporal_aggregation(
            table(spark, d, "lineitem"), "l_shipdate", MEASURES, "YE", ["sum", "count", "mean", "std"]
        ),
        2,
    )


@query
def temporal_agg_gapfill(spark, d):
    # Days without an order are listed, with sum and count 0.
    orders = table(spark, d, "orders")
    days = aggregate.temporal_aggregation(orders, "o_orderdate", ["o_totalprice"], "D", ["sum", "count", "mean"])
    return rounded(days, o_totalprice_mean=MEAN_DIGITS)


@query
def temporal_agg_gapfill_monthly(spark, d):
    # Every order, at a time that only some months have.
    sparse = F.date_add(F.lit("1995-01-31").cast("date"), (F.col("o_orderkey") % 40 * 61).cast("int"))
    orders = table(spark, d, "orders").withColumn("due", sparse)
    return rounded(aggregate.temporal_aggregation(orders, "due", ["o_totalprice"], "ME", ["max", "count"]))


@query
def temporal_agg_mixed_text(spark, d):
    # Times as text in two forms, the first and many other cells not being times.
    text = F.when(F.col("o_orderkey") % 7 < 2, F.lit("unknown")).when(
        F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")
    ).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = table(spark, d, "orders").withColumn("placed", text)
    return rounded(aggregate.temporal_aggregation(orders, "placed", ["o_totalprice"], "ME", ["max", "count"]))


@query
def derived_dataset(spark, d):
    data = Dataset(table(spark, d, "events"), Roles(time="ts", variables=("value",)), "events.parquet")
    data = data.add_recipe("value", "add_constant", "value_shifted", constant=10)
    days = data.temporal_aggregation("D", ["value", "value_shifted"], ["mean", "range"])
    return rounded(days.df(), 6)


@query
def derived_input_rows(spark, d):
    return Dataset(table(spark, d, "events"), Roles(time="ts", variables=("value",))).input_rows()


# --- descriptive statistics and relations -------------------------------------------------------------------


@query
def describe_stats(spark, d):
    return rounded(describe.descriptive_stats(table(spark, d, "lineitem"), MEASURES)["summary"])


@query
def describe_orders(spark, d):
    return rounded(describe.descriptive_stats(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])["summary"])


@query
def corr_long(spark, d):
    return relate.correlation(table(spark, d, "lineitem"), MEASURES)["pairs"]


def _incomplete(spark, d):
    """Measures with NULLs in different rows, one with a large mean and NULL in the first ones."""
    late = F.when(F.col("l_orderkey") > 500, F.col("l_quantity") + 1.7e9)
    items = table(spark, d, "lineitem").withColumn("late", late)
    holes = {"l_discount": 0.04, "l_tax": 0.02, "l_extendedprice": 2000.0}
    return items.withColumns(
        {c: F.when(F.col(c) > low, F.col(c)) for c, low in holes.items()}
    ).select(*MEASURES, "late")


@query
def corr_incomplete(spark, d):
    return relate.correlation(_incomplete(spark, d), [*MEASURES, "late"])["pairs"]


@query
def corr_matrix(spark, d):
    return relate.correlation(table(spark, d, "lineitem"), MEASURES)["matrix"]


# --- cycles -----------------------------------------------------------------------------------------------


@query
def seasonal_monthly(spark, d):
    return rounded(climatology.seasonal_patterns(table(spark, d, "orders"), *ORDERS)["monthly_climatology"])


@query
def seasonal_cycle(spark, d):
    return rounded(climatology.seasonal_patterns(table(spark, d, "orders"), *ORDERS)["seasonal_cycle"])


@query
def seasonal_summary(spark, d):
    return rounded(climatology.seasonal_patterns(table(spark, d, "orders"), *ORDERS)["summary"])


@query
def seasonal_quality(spark, d):
    return climatology.seasonal_patterns(table(spark, d, "orders"), *ORDERS)["data_quality"]


@query
def seasonal_month_pattern(spark, d):
    return rounded(climatology.seasonal_patterns(table(spark, d, "events"), *EVENTS)["monthly_pattern"])


@query
def diurnal_hourly(spark, d):
    result = climatology.diurnal_cycle(table(spark, d, "events"), *EVENTS, timezone_offset_hours=5.5)
    return rounded(result["hourly_profile"])


@query
def diurnal_season_hour(spark, d):
    result = climatology.diurnal_cycle(table(spark, d, "events"), *EVENTS, timezone_offset_hours=5.5)
    return rounded(result["seasonal_hourly_profile"])


@query
def diurnal_peaks(spark, d):
    result = climatology.diurnal_cycle(table(spark, d, "events"), *EVENTS, timezone_offset_hours=5.5)
    return rounded(result["seasonal_peaks"])


@query
def diurnal_summary(spark, d):
    result = climatology.diurnal_cycle(table(spark, d, "events"), *EVENTS, timezone_offset_hours=-3)
    return rounded(result["summary"])


@query
def diurnal_quality(spark, d):
    return climatology.diurnal_cycle(table(spark, d, "events"), *EVENTS)["data_quality"]


# --- baseline anomalies -----------------------------------------------------------------------------------


@query
def baseline_monthly(spark, d):
    return rounded(baseline.baseline_anomalies(table(spark, d, "orders"), *ORDERS, **BASELINE)["monthly_baseline"])


@query
def baseline_annual_anomalies(spark, d):
    return rounded(baseline.baseline_anomalies(table(spark, d, "orders"), *ORDERS, **BASELINE)["annual_anomalies"])


@query
def baseline_facts(spark, d):
    return rounded(baseline.baseline_anomalies(table(spark, d, "orders"), *ORDERS, **BASELINE)["baseline"])


@query
def baseline_summary(spark, d):
    return rounded(baseline.baseline_anomalies(table(spark, d, "orders"), *ORDERS, **BASELINE)["summary"])


@query
def baseline_fallback(spark, d):
    # No period matches 1950-1960, so all of them form the baseline.
    result = baseline.baseline_anomalies(
        table(spark, d, "orders"), *ORDERS, baseline_start="1950-01-01", baseline_end="1960-12-31"
    )
    return rounded(result["baseline"])


# --- extremes ---------------------------------------------------------------------------------------------


@query
def extreme_thresholds(spark, d):
    return rounded(extremes.extreme_events(table(spark, d, "orders"), *ORDERS)["thresholds"])


@query
def extreme_annual(spark, d):
    return rounded(extremes.extreme_events(table(spark, d, "orders"), *ORDERS)["annual_extremes"])


@query
def extreme_summary(spark, d):
    result = extremes.extreme_events(table(spark, d, "orders"), *ORDERS, high_quantile=0.9, low_quantile=0.1)
    return rounded(result["summary"])


# --- distributions ----------------------------------------------------------------------------------------


@query
def decadal_stats(spark, d):
    return rounded(distribution.decadal_distributions(table(spark, d, "orders"), *ORDERS)["decadal_statistics"])


@query
def decadal_hist(spark, d):
    result = distribution.decadal_distributions(table(spark, d, "orders"), *ORDERS, bins=20)
    return rounded(result["decadal_histograms"], density=12)


@query
def decadal_hist_steps(spark, d):
    result = distribution.decadal_distributions(table(spark, d, "orders"), *ORDERS, bins=20)
    return rounded(result["histogram_steps"], y=12)


@query
def decadal_summary(spark, d):
    summary = distribution.decadal_distributions(table(spark, d, "orders"), *ORDERS)["summary"]
    return summary.select(
        F.col("first_decade.decade").alias("first_decade"),
        F.col("last_decade.decade").alias("last_decade"),
        F.col("lowest_mean_decade.decade").alias("lowest_decade"),
        F.round("lowest_mean_decade.mean", 4).alias("lowest_mean"),
        F.col("highest_mean_decade.decade").alias("highest_decade"),
        F.round("highest_mean_decade.mean", 4).alias("highest_mean"),
        F.round("mean_shift_first_to_last", 4).alias("mean_shift"),
    )


# --- the combined workflow ----------------------------------------------------------------------------------


def _workflow(spark, d, frequency="D", **options):
    return workflow.climate_workflow(
        table(spark, d, "orders"), *ORDERS, aggregation_frequency=frequency, **BASELINE, **options
    )


@query
def workflow_coverage(spark, d):
    return _workflow(spark, d, "ME")["coverage"]


@query
def workflow_summary(spark, d):
    return rounded(_workflow(spark, d)["summary"])


@query
def workflow_month(spark, d):
    return rounded(_workflow(spark, d)["monthly_climatology"])


@query
def workflow_season(spark, d):
    return rounded(_workflow(spark, d, "ME")["seasonal_cycle"])


@query
def workflow_annual(spark, d):
    return rounded(_workflow(spark, d)["annual_trend"], r2=6)


@query
def workflow_annual_points(spark, d):
    return rounded(_workflow(spark, d, "ME")["annual_points"])


@query
def workflow_anomalies(spark, d):
    return rounded(_workflow(spark, d, "ME")["annual_anomalies"])


@query
def workflow_extremes(spark, d):
    return rounded(_workflow(spark, d)["extremes"])


@query
def workflow_extremes_per_year(spark, d):
    return _workflow(spark, d, "ME")["extremes_per_year"]


@query
def workflow_decade(spark, d):
    return rounded(_workflow(spark, d)["decadal_distribution"])


@query
def workflow_preview(spark, d):
    return rounded(_workflow(spark, d, preview_rows=1000)["aggregated_preview"], mean=MEAN_DIGITS)


# --- z-score anomalies --------------------------------------------------------------------------------------


@query
def zscore_anomalies(spark, d):
    found = anomaly.anomaly_rows(table(spark, d, "events"), "value", "ts", 2.0, ["event_id"])
    return rounded(found.select("event_id", "time", "value", "z_score"), 6)


@query
def zscore_listing(spark, d):
    result = anomaly.anomaly_detection(
        table(spark, d, "events"), "value", "ts", z_threshold=1.5, order_by=["event_id"], limit=500
    )
    return rounded(result["anomalies"], 6)


@query
def zscore_listing_whole(spark, d):
    result = anomaly.anomaly_detection(table(spark, d, "events"), "value", "ts", order_by=["event_id"])
    return rounded(result["anomalies"], 6)


@query
def zscore_summary(spark, d):
    result = anomaly.anomaly_detection(table(spark, d, "events"), "value", "ts", z_threshold=1.5)
    return rounded(result["coverage"], 6)


# --- models -----------------------------------------------------------------------------------------------


def _regression(spark, d):
    items = table(spark, d, "lineitem")
    return models.linear_regression(
        items, "l_extendedprice", ["l_quantity", "l_discount"], held_out=F.col("l_orderkey") % 5 == 0
    )


@query
def ols_coefficients(spark, d):
    return rounded(_regression(spark, d)["coefficients"])


@query
def ols_metrics(spark, d):
    return rounded(_regression(spark, d)["coverage"], 4, r2=8)


@query
def forest_importance(spark, d):
    result = models.random_forest_regression(
        table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"],
        split_key=["l_orderkey", "l_linenumber"],
    )
    return result["feature_importance"]


@query
def forest_net_price(spark, d):
    # A product of two columns: a line cannot follow it, the forest can.
    items = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    parts = items, "net", ["l_extendedprice", "l_discount", "l_quantity"]
    trees = models.random_forest_regression(*parts, held_out=F.col("l_orderkey") % 5 == 0)
    line = models.linear_regression(*parts, held_out=F.col("l_orderkey") % 5 == 0)
    weights = trees["feature_importance"].agg(
        F.max_by("feature", "importance").alias("top_feature"), F.round(F.sum("importance"), 9).alias("importance_total")
    )
    better = F.col("r2") > F.lit(line["coverage"].first()["r2"])
    return trees["coverage"].select("test_points", better.alias("above_line")).crossJoin(weights)


@query
def forecast_ar2(spark, d):
    days = aggregate.temporal_aggregation(
        table(spark, d, "orders"), "o_orderdate", ["o_totalprice"], "ME", ["mean"], verify=False
    )
    result = forecast.time_series_forecasting(days, "period_start", "o_totalprice_mean", lags=2, horizon=12)
    return rounded(result["forecast"], 3)


@query
def forecast_coefficients(spark, d):
    result = forecast.time_series_forecasting(
        table(spark, d, "events"), "ts", "value", lags=2, horizon=12, order_by=["event_id"]
    )
    return rounded(result["model_coefficients"], 6)


@query
def forecast_steps(spark, d):
    # Event times are irregular, so the forecast is numbered instead of dated.
    result = forecast.time_series_forecasting(
        table(spark, d, "events"), "ts", "value", lags=2, horizon=6, order_by=["event_id"]
    )
    return rounded(result["forecast"], 4)


@query
def forecast_six_lags(spark, d):
    """The default number of lags. Least squares is known by its residuals: their mean is 0 and they go with none of the lags."""
    events = table(spark, d, "events")
    result = forecast.time_series_forecasting(events, *EVENTS, order_by=["event_id"])
    weights = {r["lag"]: r["coefficient"] for r in result["model_coefficients"].collect()}
    facts = result["coverage"].first()
    indexed, _ = number_rows(events.select("ts", "event_id", "value").dropna(), ["ts", "event_id"], "row_index")
    rows = lagged(indexed.select("row_index", "value"), "value", len(weights)).dropna()
    fitted = F.lit(facts["model_intercept"])
    for lag, weight in weights.items():
        fitted = fitted + F.col(lag) * F.lit(weight)
    rows = rows.withColumn("rest", F.col("value") - fitted)
    none = F.abs(F.avg("rest")) < 1e-6 * F.stddev_pop("value")
    for lag in weights:
        none = none & (F.abs(F.corr("rest", lag)) < 1e-6)
    return rows.agg(F.count(F.lit(1)).alias("rows_fitted"), F.lit(len(weights)).alias("lags"), none.alias("uncorrelated")).withColumn(
        "steps", F.lit(result["forecast"].count())
    )


# --- recipes ----------------------------------------------------------------------------------------------


@query
def recipe_units(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    made = [
        recipes.make_recipe("p_retailprice", op, op)
        for op in (
            "kelvin_to_celsius", "kelvin_to_fahrenheit", "celsius_to_kelvin", "ms_to_kmh", "ms_to_mph", "pa_to_hpa",
        )
    ]
    return rounded(recipes.apply_recipes(part, made), 6)


@query
def recipe_arith(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size")
    made = [
        recipes.make_recipe("p_size", op, op, constant=c)
        for op, c in (
            ("multiply_constant", 2.5), ("divide_constant", 4), ("add_constant", 100), ("subtract_constant", 0.75),
        )
    ]
    return rounded(recipes.apply_recipes(part, made), 6)


@query
def recipe_rolling_mean(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "value")
    return rounded(recipes.rolling_column(events, "value", "ts", 7, "rolled", ["event_id"]), rolled=MEAN_DIGITS)


@query
def recipe_rolling_mean_long(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "value")
    return rounded(recipes.rolling_column(events, "value", "ts", 365, "rolled", ["event_id"]), rolled=9)


@query
def recipe_day_mean(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "value")
    recipe = recipes.make_recipe("value", "aggregate_by_day", time_column="ts")
    return rounded(recipes.apply_recipe(events, recipe), 6)


@query
def recipe_month_mean(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    recipe = recipes.make_recipe("o_totalprice", "aggregate_by_month", time_column="o_orderdate")
    return rounded(recipes.apply_recipe(orders, recipe))


@query
def recipe_chain(spark, d):
    data = Dataset(table(spark, d, "events"), Roles(time="ts", variables=("value",)))
    data = data.add_recipe("value", "celsius_to_kelvin", "kelvin")
    data = data.add_recipe("kelvin", "kelvin_to_fahrenheit", "fahrenheit")
    data = data.add_recipe("fahrenheit", "aggregate_by_day", "fahrenheit_day")
    return rounded(data.df(["event_id", "kelvin", "fahrenheit", "fahrenheit_day"]))


@query
def recipe_month_mean_no_time(spark, d):
    # Rows without a time form a month of their own.
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("placed"), "o_totalprice"
    )
    recipe = recipes.make_recipe("o_totalprice", "aggregate_by_month", "monthmean", time_column="placed")
    return rounded(recipes.apply_recipe(orders, recipe))


@query
def recipe_suggest(spark, d):
    """Units travel with the file's columns; each suggestion is carried out on all rows."""
    path = fresh_folder(spark, "units") + ".parquet"
    events = table(spark, d, "events").select("event_id", F.col("value").alias("air_k"), F.col("value").alias("push"), F.col("value").alias("wind"))
    write_parquet(recipes.with_units(events, {"push": " PA ", "wind": "m s-1"}), path)
    data = Dataset.from_df(read_table(spark, path), Roles(variables=("air_k", "push", "wind")))
    for row in data.suggestions().collect():
        data = data.add_recipe(row["source_variable"], row["operation"], row["suggested_output"])
    return rounded(data.df(["event_id", *data.derived_columns]), 6)


@query
def recipe_checks(spark, d):
    """Which recipes are refused: a division by a column's minimum where that is 0, an output that is there already, no time column."""
    items = table(spark, d, "lineitem")
    lows = items.agg(*[F.min(c).alias(c) for c in MEASURES]).first()
    data = Dataset(items.select(*MEASURES), Roles(variables=tuple(MEASURES)))
    tried = [(c, "divide_constant", f"{c}_part", {"constant": lows[c]}) for c in MEASURES]
    tried += [(c, "add_constant", MEASURES[0], {"constant": lows[c]}) for c in MEASURES]
    tried += [(c, "rolling_mean", f"{c}_smooth", {"window": lows[c]}) for c in MEASURES]
    out = []
    for source, operation, output, parameters in tried:
        try:
            data.add_recipe(source, operation, output, **parameters)
            refused = False
        except ValueError:
            refused = True
        out.append((source, operation, refused))
    return spark.createDataFrame(out, "source string, operation string, refused boolean")


# --- roles --------------------------------------------------------------------------------------------------


@query
def infer_roles(spark, d):
    events = table(spark, d, "events")
    return roles.roles_table(events, roles.infer_roles(events))


@query
def infer_roles_ranges(spark, d):
    items = table(spark, d, "lineitem").select("l_shipdate", "l_returnflag", "l_tax", "l_extendedprice", "l_discount")
    return roles.roles_table(items, roles.infer_roles(items))


@query
def infer_roles_text(spark, d):
    # Dates written as text are recognised from all values.
    text = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "M/d/yyyy").alias("placed"), "o_orderpriority", "o_totalprice"
    )
    return roles.roles_table(text, roles.infer_roles(text))


# --- charts -------------------------------------------------------------------------------------------------


@query
def spatial_grid(spark, d):
    grid = charts.spatial_grid(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", 12, 8)
    return rounded(grid, value=MEAN_DIGITS)


@query
def spatial_grid_default(spark, d):
    # Sums of whole numbers are exact in any order.
    grid = charts.spatial_grid(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_partkey")
    return rounded(grid, value=8)


@query
def spatial_grid_matrix(spark, d):
    grid = charts.spatial_grid(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", 6, 4)
    wide = charts.grid_matrix(grid, 4)
    return rounded(wide.toDF("lat_bin", *[f"lon_{i}" for i in range(4)]), MEAN_DIGITS)


@query
def grid_edges(spark, d):
    return rounded(charts.grid_edges(table(spark, d, "lineitem"), "l_extendedprice", 10), 6)


@query
def chart_heatmap_corr(spark, d):
    return charts.heatmap(table(spark, d, "lineitem").select(*MEASURES))


@query
def map_points(spark, d):
    points = charts.map_points(
        table(spark, d, "lineitem"), "l_quantity", "l_tax", "l_extendedprice", max_points=5000,
        order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    )
    return points


@query
def systematic_sample_rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return systematic_sample(orders, 1000, ["o_orderdate", "o_orderkey"])


@query
def chart_time_series(spark, d):
    return charts.time_series(table(spark, d, "events"), *EVENTS)


@query
def chart_scatter(spark, d):
    return charts.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query
def chart_anomaly(spark, d):
    return charts.anomaly_graph(table(spark, d, "events"), "value", "ts", z_threshold=1.5)


# --- sources and sinks --------------------------------------------------------------------------------------


@query
def flatten_grid_cells(spark, d):
    blocks = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    size = F.size("v")
    blocks = blocks.select(
        "vec_id",
        F.transform(F.sequence(F.lit(0), (size / 8).cast("int") - 1), lambda i: i * 10).alias("lat_axis"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i + 100).alias("lon_axis"),
        F.col("v"),
    )
    cells = flatten_grid(
        blocks, {"lat": "lat_axis", "lon": "lon_axis", "level": [850, 500]}, ["v"], keep=["vec_id"]
    )
    return rounded(cells, 6)


@query
def flatten_raster_points(spark, d):
    tiles = table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: F.when(x > 0, x.cast("double"))).alias("pixels")
    )
    return rounded(flatten_raster(tiles, "pixels", 8, (0.5, 0.0, -10.0, 0.0, -0.25, 60.0), keep=["vec_id"]), 6)


@query
def standardize_cells(spark, d):
    raw = table(spark, d, "events").select(
        F.col("event_id").alias(" event_id "),
        F.encode("props", "utf-8").alias("props "),
        F.array("user_id", "event_id").alias("pair"),
    )
    return standardize(raw)


@query
def coerce_quality(spark, d):
    events = table(spark, d, "events")
    text = events.select(
        "event_type",
        F.regexp_extract("props", r"([0-9]+)", 1).alias("k"),
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")).alias("padded"),
        F.concat(F.col("user_id").cast("string"), F.lit("d")).alias("literal"),
        "props",
    )
    return text.groupBy("event_type").agg(
        F.count(number(text, "k")).alias("k_numbers"),
        F.sum(number(text, "k")).alias("k_sum"),
        F.count(number(text, "padded")).alias("padded_numbers"),
        F.round(F.sum(number(text, "padded")), 4).alias("padded_sum"),
        F.count(number(text, "literal")).alias("literal_numbers"),
        F.count(number(text, "props")).alias("props_numbers"),
    )


@query
def csv_round_trip(spark, d):
    """Written as CSV and read again: quotes, separators and line breaks in cells, missing-value tokens, inferred types."""
    path = fresh_folder(spark, "orders") + ".csv"
    mark = F.concat(F.lit('two "lines",\n'), "o_orderpriority")
    word = F.when(F.col("o_orderkey") % 3 == 0, "NA").when(F.col("o_orderkey") % 3 == 1, "x")
    orders = table(spark, d, "orders")
    write_csv(orders.select("o_orderkey", mark.alias("mark"), word.alias("word"), (F.col("o_custkey") % 2 == 0).alias("even"), "o_totalprice"), path)
    return read_table(spark, path)


@query
def parquet_by_year(spark, d):
    """One folder a year; the folder's column is not part of the table."""
    path = fresh_folder(spark, "years") + ".parquet"
    write_parquet(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), path, year_of="o_orderdate")
    return rounded(read_table(spark, path).where("year(o_orderdate) > 1995"))


@query
def export_primary(spark, d):
    """The result's first table as CSV, read again."""
    path = fresh_folder(spark, "primary") + ".csv"
    export_result(relate.correlation(table(spark, d, "lineitem"), MEASURES), path)
    return read_table(spark, path)


@query
def export_every_table(spark, d):
    """Each table of a result in a folder of its own; the summary is read again."""
    path = fresh_folder(spark, "tables")
    export_tables(baseline.baseline_anomalies(table(spark, d, "orders"), *ORDERS, **BASELINE), path)
    return rounded(read_table(spark, f"{path}/summary", "csv"))


@query
def capped_ingest(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias(" price "))
    return standardize(orders, max_rows=777, order_by=["o_orderkey"])


@query
def raster_capped(spark, d):
    tiles = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))
    points = flatten_raster(tiles, "pixels", 8, (0.5, 0.0, -10.0, 0.0, -0.25, 60.0), keep=["vec_id"], max_points=999, order_by=["vec_id"])
    return rounded(points, 6)


@query
def override_roles(spark, d):
    """All roles replaced by hand; resampling then follows them, and repeated aggregations count once."""
    data = Dataset.from_df(table(spark, d, "lineitem"), name="items").set_roles(time="l_shipdate", variables=["l_tax", "l_discount"])
    return rounded(data.temporal_aggregation("YE", aggregations=["count", "max", "count"]).df())


@query
def size_guards(spark, d):
    """Analyses that refuse too few rows: trends need three years, regressions ten complete rows, forests thirty, forecasts more than
    five beyond their lags. The tables are the yearly, monthly and daily means of all orders."""
    checks = {
        "annual_trend": lambda part: trend.annual_trend_signal(part, "period_start", "o_totalprice_mean", checked=True)["annual_series"],
        "regression": lambda part: models.linear_regression(part, "o_totalprice_mean", ["o_totalprice_count"])["coverage"],
        "forest": lambda part: models.random_forest_regression(part, "o_totalprice_mean", ["o_totalprice_count"], n_estimators=2)["coverage"],
        "forecast": lambda part: forecast.time_series_forecasting(part, "period_start", "o_totalprice_mean")["forecast"],
    }
    out = []
    for code in ("YE", "ME", "D"):
        part = aggregate.temporal_aggregation(table(spark, d, "orders"), "o_orderdate", ["o_totalprice"], code, ["mean", "count"])
        for name, run in checks.items():
            try:
                run(part.dropna())
                refused = False
            except ValueError:
                refused = True
            out.append((name, code, refused))
    return spark.createDataFrame(out, "analysis string, period string, refused boolean")


@query
def readable_times(spark, d):
    """A recipe over time is refused where the time column has no readable cell."""
    events = table(spark, d, "events").select(
        F.date_format("ts", "M/d/yyyy H:mm:ss").alias("us"), F.date_format("ts", "yyyyMMdd").alias("plain"), "event_type", "props", "value",
        F.when(F.col("event_id") == 17, F.date_format("ts", "d MMM yyyy")).otherwise(F.lit("n/a")).alias("rare"),
    )
    data = Dataset(events, Roles(variables=("value",)))
    out = []
    for column in ("us", "plain", "event_type", "props", "rare"):
        try:
            data.add_recipe("value", "aggregate_by_day", f"by_{column}", time_column=column)
            out.append((column, True))
        except ValueError:
            out.append((column, False))
    return spark.createDataFrame(out, "column string, readable boolean")


@query
def preview_limits(spark, d):
    """A limit is a number or text; out of bounds or unreadable ones give the nearest bound or the default."""
    data = Dataset(table(spark, d, "orders"), Roles(time="o_orderdate"))
    out = []
    for k, limit in enumerate(("7", " 12 ", "7.5", "many", None, -3, "0", 2.9)):
        page = data.preview(["o_orderkey"], limit).select(F.lit(k).alias("case"), "o_orderkey")
        out.append(page)
    whole = out[0]
    for page in out[1:]:
        whole = whole.unionAll(page)
    return whole


@query
def zscore_listing_text(spark, d):
    """Times given as text are shown in ISO form, unreadable ones as they are."""
    events = table(spark, d, "events").select(
        "event_id", "value", F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "M/d/yyyy H:mm:ss")).otherwise(F.lit("unknown")).alias("noted")
    )
    result = anomaly.anomaly_detection(events, "value", "noted", order_by=["event_id"])
    return rounded(result["anomalies"], 6)


@query
def preview_page(spark, d):
    data = Dataset(table(spark, d, "orders"), Roles(time="o_orderdate", variables=("o_totalprice",)))
    return data.preview(["o_orderkey"], 100, 250)


@query
def dataset_profile(spark, d):
    data = Dataset(
        table(spark, d, "orders"), Roles(time="o_orderdate", variables=("o_totalprice",)), "orders.parquet", "parquet"
    )
    profile = data.add_recipe("o_totalprice", "divide_constant", "thousands", constant=1000).profile()
    return profile.select(
        "name",
        "source_format",
        F.array_join("columns", ",").alias("columns"),
        F.array_join("derived_columns", ",").alias("derived_columns"),
        "time_column",
        F.array_join("climate_variables", ",").alias("climate_variables"),
        "row_count",
    )


@query
def dataset_list(spark, d):
    known = [
        Dataset(table(spark, d, name), Roles(), f"{name}.parquet", "parquet") for name in ("orders", "lineitem", "events")
    ]
    listed = list_datasets(spark, known)
    return listed.select("name", "source_format", "row_count", F.size("columns").alias("column_count"))


@query
def export_flat(spark, d):
    """The one-row form that an export writes for a result without a leading record table."""
    result = trend.annual_trend_signal(table(spark, d, "orders"), *ORDERS)
    flat = result.primary()
    return rounded(flat.toDF(*[c.replace(".", "_") for c in flat.columns]), summary_r2=6)
