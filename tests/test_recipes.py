"""Derived columns and role inference."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldstats import Roles
from fieldstats.operators.recipes import (
    apply_recipe,
    apply_recipes,
    make_recipe,
    rolling_column,
    suggest_recipes,
    with_units,
)
from fieldstats.operators.roles import infer_roles, is_datetime_like
from tests.conftest import rows


def test_kelvin_to_celsius(spark):
    df = spark.createDataFrame([(273.15,), (280.15,), (290.15,)], "t2m double")
    got = apply_recipe(df, make_recipe("t2m", "kelvin_to_celsius", "t2m_c"))
    assert [r["t2m_c"] for r in got.collect()] == pytest.approx([0.0, 7.0, 17.0])


@pytest.mark.parametrize(
    "operation,value,expected",
    [
        ("kelvin_to_fahrenheit", 300.0, (300 - 273.15) * 9 / 5 + 32),
        ("celsius_to_kelvin", 10.0, 283.15),
        ("ms_to_kmh", 10.0, 36.0),
        ("ms_to_mph", 10.0, 22.369362921),
        ("pa_to_hpa", 101325.0, 1013.25),
    ],
)
def test_unit_conversions(spark, operation, value, expected):
    df = spark.createDataFrame([(str(value),), ("n/a",), (None,)], "x string")
    got = [r["y"] for r in apply_recipe(df, make_recipe("x", operation, "y")).collect()]
    assert got == [pytest.approx(expected), None, None]


def test_constant_arithmetic(spark):
    df = spark.createDataFrame([(8,)], "x int")
    made = [make_recipe("x", op, constant=c) for op, c in (("multiply_constant", "2"), ("divide_constant", 4), ("add_constant", 1), ("subtract_constant", 3))]
    got = apply_recipes(df, made).head().asDict()
    assert got == {"x": 8, "x_mul": 16.0, "x_div": 2.0, "x_add": 9.0, "x_sub": 5.0}


@pytest.mark.parametrize(
    "args",
    [
        ("x", "divide_constant", "y", {"constant": 0}),
        ("x", "add_constant", "y", {}),
        ("x", "add_constant", "y", {"constant": "many"}),
        ("x", "add_constant", "x", {"constant": 1}),
        (" ", "ms_to_kmh", "y", {}),
        ("x", "ms_to_kmh", " ", {}),
        ("x", "rolling_mean", "y", {"window": 3}),
        ("x", "rolling_mean", "y", {"window": 0, "time_column": "t"}),
        ("x", "aggregate_by_day", "y", {}),
        ("x", "square", "y", {}),
    ],
)
def test_bad_recipes_are_refused(args):
    source, operation, output, parameters = args
    with pytest.raises(ValueError):
        make_recipe(source, operation, output, None, **parameters)


def test_recipe_keeps_only_what_it_reads():
    recipe = make_recipe("x", "rolling_mean", "y", Roles(time="t"), window="5", colour="red")
    assert recipe.parameters == {"time_column": "t", "window": 5}


def test_rolling_mean_follows_time_order(frame):
    pdf = pd.DataFrame({"time": pd.date_range("2024-01-01", periods=4), "temp": [10.0, 12, 14, 16]})
    got = apply_recipe(frame(pdf.sample(frac=1, random_state=1)), make_recipe("temp", "rolling_mean", "r", Roles(time="time"), window=2))
    assert [r["r"] for r in rows(got, "time")] == [10.0, 11.0, 13.0, 15.0]
    assert got.columns == ["time", "temp", "r"]


def test_rolling_mean_puts_missing_times_last(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-03", 3.0), (2, None, 10.0), (3, "2024-01-01", 1.0), (4, "bad", 20.0)], "id int, t string, v double"
    )
    got = rows(rolling_column(df, "v", "t", 2, "r", ["id"]), "id")
    assert [r["r"] for r in got] == [2.0, 6.5, 1.0, 15.0]


def test_rolling_mean_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(i, "2024-01-01", float(i)) for i in range(300)], "id int, t string, v double").repartition(7)
    got = rows(rolling_column(df, "v", "t", 3, "r", ["id"], block_rows=16), "id")
    want = pd.Series(np.arange(300.0)).rolling(3, min_periods=1).mean()
    assert [r["r"] for r in got] == pytest.approx(list(want))


def test_day_and_month_means(spark):
    df = spark.createDataFrame(
        [("2024-01-02", 1.0), (None, 2.0), ("2024-01-01", 3.0), ("2024-01-02 12:00:00", 5.0), ("junk", 4.0)], "t string, v double"
    )
    day = apply_recipe(df, make_recipe("v", "aggregate_by_day", "m", time_column="t"))
    assert {r["v"]: r["m"] for r in day.collect()} == {1.0: 3.0, 2.0: None, 3.0: 3.0, 5.0: 3.0, 4.0: None}
    month = apply_recipe(df, make_recipe("v", "aggregate_by_month", "m", time_column="t"))
    assert {r["v"]: r["m"] for r in month.collect()} == {1.0: 3.0, 2.0: 3.0, 3.0: 3.0, 5.0: 3.0, 4.0: 3.0}


def test_calendar_mean_does_not_shuffle_the_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).select(F.timestamp_seconds("id").alias("t"), "id").write.parquet(path)
    df = spark.read.parquet(path)
    got = apply_recipe(df, make_recipe("id", "aggregate_by_day", "m", time_column="t"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan


def test_suggestions(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], "t2m double, sp double, u10 double, skin_K double, other double")
    df = with_units(df, {"t2m": " K ", "sp": "Pa", "u10": "m s**-1"})
    got = {(r["source_variable"], r["operation"], r["suggested_output"]) for r in suggest_recipes(df).collect()}
    assert got == {
        ("t2m", "kelvin_to_celsius", "t2m_c"),
        ("sp", "pa_to_hpa", "sp_hpa"),
        ("u10", "ms_to_kmh", "u10_kmh"),
        ("skin_K", "kelvin_to_celsius", "skin_K_c"),
    }
    done = df.withColumn("t2m_c", F.lit(0.0))
    assert "t2m" not in {r["source_variable"] for r in suggest_recipes(done).collect()}
    assert suggest_recipes(df, {"other": "mps"}).where("source_variable = 'other'").count() == 1


def test_a_known_unit_stops_the_name_rule(spark):
    df = spark.createDataFrame([(1.0,)], "skin_k double")
    assert suggest_recipes(df, {"skin_k": "mm"}).count() == 0


def test_infer_roles(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 10.0, 20.0, 15.0), ("2024-01-02", 11.0, 21.0, 16.0)],
        "timestamp string, latitude double, longitude double, temperature double",
    )
    roles = infer_roles(df)
    assert (roles.time, roles.latitude, roles.longitude, roles.variables) == ("timestamp", "latitude", "longitude", ("temperature",))
    assert roles.column_types["temperature"] == "numeric"


def test_hints_are_substrings_taken_in_column_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "humidity double, max_wind double, lat double, pressure double")
    roles = infer_roles(df)
    assert (roles.latitude, roles.longitude) == ("humidity", "max_wind")
    assert roles.variables == ("pressure",)


def test_coordinates_by_range_and_default_variables(spark):
    names = ", ".join(f"c{i} double" for i in range(12))
    df = spark.createDataFrame([tuple(float(i * 40) for i in range(12))], names)
    roles = infer_roles(df)
    assert roles.latitude == "c0" and roles.longitude == "c0"
    assert roles.variables == tuple(f"c{i}" for i in range(1, 12))
    assert infer_roles(df, variable_count=8).variables == tuple(f"c{i}" for i in range(1, 9))


def test_later_time_hint_wins(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-05-01", "x")], "noted string, sample_date string, label string")
    roles = infer_roles(df)
    assert roles.time == "sample_date"
    assert roles.column_types == {"noted": "time", "sample_date": "time", "label": "categorical"}


def test_booleans_are_numeric_types_but_not_features(spark):
    df = spark.createDataFrame([(True, 500.0)], "flag boolean, v double")
    roles = infer_roles(df)
    assert roles.column_types["flag"] == "numeric" and roles.variables == ("v",)


@pytest.mark.parametrize(
    "values,expected",
    [
        (["2024-01-01", None, "2024-01-02"], True),
        (["1/2/2024", "12/31/2023"], True),
        (["20240102", "20240103"], True),
        (["Jan 5 2024", "Feb 6 2024"], True),
        (["2024-01-01"] * 8 + ["?"] * 2, True),
        (["2024-01-01"] * 7 + ["?"] * 3, False),
        (["red", "green"], False),
        ([None, None], False),
    ],
)
def test_datetime_likeness(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "t string").coalesce(1)
    assert is_datetime_like(df, "t") is expected


def test_role_override_replaces_everything_but_types():
    roles = Roles("t", "lat", "lon", ("a",), {"a": "numeric"})
    changed = roles.override(time="u")
    assert (changed.time, changed.latitude, changed.longitude, changed.variables) == ("u", None, None, ())
    assert changed.column_types == {"a": "numeric"}
    derived = changed.with_derived(["b", "a"])
    assert derived.variables == ("b", "a") and derived.column_types == {"a": "numeric", "b": "derived_numeric"}
