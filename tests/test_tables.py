"""Resampling, models, charts, sources, sinks, datasets and streaming."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldstats import ANALYSES, CHARTS, Dataset, Roles, analyze, chart, list_datasets
from fieldstats.functions.calendar import frequency
from fieldstats.functions.options import option
from fieldstats.operators import charts
from fieldstats.operators.aggregate import temporal_aggregation
from fieldstats.operators.forecast import extend_times, spacing, time_series_forecasting
from fieldstats.operators.models import linear_regression, random_forest_regression
from fieldstats.operators.trend import annual_trend_signal
from fieldstats.operators.anomaly import anomaly_detection
from fieldstats.operators.relate import correlation
from fieldstats.operators.roles import infer_roles
from fieldstats.sources.flatten import flatten_grid, flatten_raster
from fieldstats.sources.readers import detect_format, read_csv, read_table
from fieldstats.sources.sinks import export_result, export_tables, page, write_parquet
from fieldstats.sources.standardize import standardize
from fieldstats.streaming.periods import stream_daily_aggregation
from tests.conftest import rows


def stations(frame):
    times = pd.date_range("2024-01-01", periods=48, freq="h")
    air = [*range(24), *range(10, 34)]
    return frame(
        pd.DataFrame({"stamp": times, "air": air, "water": [2.0] * 24 + [4.0] * 24, "station": "A"})
    )


def test_derived_dataset(frame):
    data = Dataset.from_df(stations(frame), name="stations.csv")
    days = data.temporal_aggregation("D", ["air", "water", "station"], ["mean", "min", "max", "range"])
    got = rows(days.df(), "period_start")
    assert len(got) == 2 and "station_mean" not in got[0]
    assert got[0]["air_mean"] == 11.5 and got[0]["air_range"] == 23
    assert got[1]["air_min"] == 10 and got[1]["water_mean"] == 4.0
    assert days.mapping.time == "period_start" and days.name == "stations_daily"
    assert days.provenance["parent_dataset_name"] == "stations.csv"
    assert days.provenance["value_columns"] == ["air", "water"]
    assert rows(data.input_rows()) == [{"input_rows": 48, "valid_time_rows": 48}]


def gappy(frame):
    return frame(
        pd.DataFrame(
            {
                "t": pd.to_datetime(["2024-02-01", "2024-02-01 06:00", "2024-02-03", "2024-02-05"], format="ISO8601"),
                "v": [1.0, 3.0, np.nan, 5.0],
            }
        )
    )


def test_gap_rule(frame):
    df = gappy(frame)
    counted = rows(temporal_aggregation(df, "t", ["v"], "D", ["mean", "count", "sum"]), "period_start")
    assert [r["v_count"] for r in counted] == [2, 0, 0, 0, 1]
    assert [r["v_sum"] for r in counted] == [4.0, 0.0, 0.0, 0.0, 5.0]
    assert counted[2]["v_mean"] is None
    plain = rows(temporal_aggregation(df, "t", ["v"], "D", ["mean", "range", "mean"]), "period_start")
    assert [(r["v_mean"], r["v_range"]) for r in plain] == [(2.0, 2.0), (5.0, 0.0)]


@pytest.mark.parametrize("name,label", [("M", "2024-01-31"), ("yearly", "2024-12-31"), ("Day", "2024-01-09")])
def test_period_labels(frame, name, label):
    df = frame(pd.DataFrame({"t": pd.to_datetime(["2024-01-09 05:00", "2024-01-09 23:59"]), "v": [1.0, 2.0]}))
    got = rows(temporal_aggregation(df, "t", ["v"], name))
    assert [str(r["period_start"])[:10] for r in got] == [label]


@pytest.mark.parametrize("code,expected", [("ME", 14), ("YE", 2)])
def test_month_and_year_gaps(frame, code, expected):
    df = frame(pd.DataFrame({"t": pd.to_datetime(["2023-12-31", "2025-01-30"]), "v": [1.0, 2.0]}))
    if code == "YE":
        df = df.where("v = 1").union(df.where("v = 2").withColumn("t", F.expr("t - interval 1 year")))
    got = rows(temporal_aggregation(df, "t", ["v"], code, ["count"]), "period_start")
    assert len(got) == expected and got[0]["v_count"] == 1 and got[-1]["v_count"] == 1
    ends = pd.date_range(got[0]["period_start"], periods=expected, freq=code)
    assert [r["period_start"] for r in got] == [e.to_pydatetime() for e in ends]


def test_aggregation_arguments(frame):
    df = stations(frame)
    for bad in (dict(aggregations=[]), dict(aggregations=["mode"]), dict(frequency="W"), dict(columns=["station"])):
        with pytest.raises(ValueError):
            temporal_aggregation(df, "stamp", **{"columns": ["air"], **bad})
    with pytest.raises(ValueError):
        temporal_aggregation(df, None, ["air"])
    assert frequency(" monthly ") == "ME"


def test_linear_regression(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=2000), rng.normal(size=2000)
    pdf = pd.DataFrame({"id": range(2000), "a": a, "b": b, "y": 2 * a - b + 3 + rng.normal(size=2000) * 0.01})
    result = linear_regression(spark.createDataFrame(pdf), "y", ["a", "b"], split_key=["id"])
    weights = {r["feature"]: r["coefficient"] for r in rows(result["coefficients"])}
    assert weights == {"a": pytest.approx(2, abs=1e-2), "b": pytest.approx(-1, abs=1e-2)}
    score = rows(result["coverage"])[0]
    assert score["r2"] > 0.999 and score["rmse"] < 0.02 and 300 < score["test_points"] < 500
    again = linear_regression(spark.createDataFrame(pdf).repartition(9), "y", ["a", "b"], split_key=["id"])
    assert rows(again["coverage"])[0]["test_points"] == score["test_points"]
    with pytest.raises(ValueError, match="10"):
        linear_regression(spark.createDataFrame(pdf).limit(9), "y", ["a", "b"])


def test_random_forest(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.random(600), "b": rng.random(600)})
    pdf["y"] = np.where(pdf.a > 0.5, 10.0, 0.0)
    result = random_forest_regression(spark.createDataFrame(pdf), "y", ["a", "b"], n_estimators=5, max_depth=4)
    weights = {r["feature"]: r["importance"] for r in rows(result["feature_importance"])}
    assert weights["a"] > 0.95 and sum(weights.values()) == pytest.approx(1)
    assert rows(result["coverage"])[0]["r2"] > 0.9
    with pytest.raises(ValueError, match="30"):
        random_forest_regression(spark.createDataFrame(pdf).limit(20), "y", ["a", "b"])


def ar_forecast(values, lags, horizon):
    frame = pd.DataFrame({"y": values})
    for k in range(1, lags + 1):
        frame[f"l{k}"] = frame.y.shift(k)
    frame = frame.dropna()
    design = np.column_stack([frame[[f"l{k}" for k in range(1, lags + 1)]], np.ones(len(frame))])
    weights = np.linalg.lstsq(design, frame.y, rcond=None)[0]
    history = list(values)
    for _ in range(horizon):
        history.append(float(np.dot(weights[:-1], history[: -lags - 1 : -1]) + weights[-1]))
    return history[-horizon:], weights


@pytest.mark.parametrize("lags", [1, 2, 6])
def test_forecast_equals_direct_least_squares(frame, lags):
    rng = np.random.default_rng(lags)
    values = np.cumsum(rng.normal(size=300)) * 0.1 + np.sin(np.arange(300) / 5)
    pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=300, freq="6h"), "v": values})
    result = time_series_forecasting(frame(pdf.sample(frac=1, random_state=2)), "t", "v", lags=lags, horizon=8, block_rows=32)
    want, weights = ar_forecast(values, lags, 8)
    got = rows(result["forecast"], "time")
    assert [r["forecast"] for r in got] == pytest.approx(want, rel=1e-6)
    assert [r["time"] for r in got] == [t.to_pydatetime() for t in pd.date_range(pdf.t.iloc[-1], periods=9, freq="6h")[1:]]
    assert [r["coefficient"] for r in rows(result["model_coefficients"], "lag")] == pytest.approx(list(weights[:-1]), rel=1e-6)


def test_forecast_needs_more_rows_than_lags(frame):
    df = frame(pd.DataFrame({"t": pd.date_range("2024-01-01", periods=11), "v": np.arange(11.0)}))
    with pytest.raises(ValueError, match="11"):
        time_series_forecasting(df, "t", "v", lags=6)


@pytest.mark.parametrize("freq", ["D", "h", "15min", "MS", "ME", "YE", "YS", "QS", "QE", "B", "7D", "2MS"])
def test_future_times_continue_the_spacing(spark, freq):
    times = list(pd.date_range("2020-01-31", periods=40, freq=freq))
    got = extend_times(seen(spark, [t.to_pydatetime() for t in times[:30]]), times[29].to_pydatetime(), 10)
    assert got == [t.to_pydatetime() for t in times[30:]]


def seen(spark, times):
    return spacing(spark.createDataFrame(list(enumerate(times)), "row_index bigint, time timestamp_ntz"), block_rows=7)


def test_irregular_times_have_no_spacing(spark):
    times = [datetime(2024, 1, d) for d in (1, 2, 4, 9)]
    assert extend_times(seen(spark, times), times[-1], 3) is None
    assert extend_times(seen(spark, times[:2]), times[1], 3) is None
    assert extend_times(seen(spark, [times[0]] * 3), times[0], 3) is None
    late = [datetime(2024, 1, 1) + timedelta(days=d + (d > 700)) for d in range(800)]  # a gap far behind the start
    assert extend_times(seen(spark, late), late[-1], 3) is None


def test_spatial_grid_equals_cut(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"lat": rng.uniform(-60, 60, 2000).round(1), "lon": rng.uniform(0, 20, 2000).round(1), "v": rng.normal(size=2000)})
    got = rows(charts.spatial_grid(spark.createDataFrame(pdf), "lat", "lon", "v", 9, 7))
    want = pdf.assign(a=pd.cut(pdf.lat, 9, labels=False), o=pd.cut(pdf.lon, 7, labels=False)).groupby(["a", "o"]).v.mean()
    assert len(got) == 63
    for r in got:
        assert r["value"] == pytest.approx(want.get((r["lat_bin"], r["lon_bin"]), 0.0))
    edges = rows(charts.grid_edges(spark.createDataFrame(pdf), "lat", 9), "bin")
    intervals = pd.cut(pdf.lat, 9, precision=12).cat.categories
    assert [e["left"] for e in edges] == pytest.approx(list(intervals.left), abs=1e-9)


def test_heatmap_falls_back_to_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x"), (2.0, 2.0, "y"), (3.0, 2.0, "z")], "a double, b double, c string")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in rows(charts.heatmap(df))}
    assert got == {("a", "a"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 0.0}


def test_map_points(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), None if i == 3 else i / 7) for i in range(101)], "id int, lat double, lon double, v double")
    got = rows(charts.map_points(df, "lat", "lon", "v", max_points=10, order_by=["id"]), "lat")
    kept = [float(i) for i in range(101) if i != 3]
    assert [r["lat"] for r in got] == [kept[i] for i in np.linspace(0, 99, 10, dtype=int)]
    assert got[1]["value"] == round(got[1]["lat"] / 7, 6)


def test_chart_rows(spark):
    df = spark.createDataFrame([("2024-01-02", 1.23456789, 5.0), ("2024-01-01", 2.0, None), ("bad", 3.0, 1.0)], "t string, v double, w double")
    line = [r.asDict() for r in charts.time_series(df, "t", "v").collect()]
    assert [r["value"] for r in line] == [2.0, 1.234568]
    assert sorted((r["x"], r["y"]) for r in charts.scatter(df).collect()) == [(1.23456789, 5.0), (3.0, 1.0)]
    flagged = rows(charts.anomaly_graph(df, "v", "t", z_threshold=1.2), "value")
    assert [r["is_anomaly"] for r in flagged] == [False, False, True] and flagged[2]["x"] is None
    numbered = rows(charts.anomaly_graph(df.coalesce(1), "v", z_threshold=1.2), "x")
    assert [r["x"] for r in numbered] == [0, 1, 2]


def test_analyses_and_charts_by_name(frame):
    times = pd.date_range("2015-01-01", periods=1500, freq="30h")
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"time": times, "temperature": rng.normal(size=1500), "rain": rng.random(1500), "lat": 5.0, "lon": rng.random(1500)})
    data = Dataset.from_df(frame(pdf))
    assert len(ANALYSES) == 16 and len(CHARTS) == 5
    for kind in ANALYSES:
        extra = {"n_estimators": 3, "max_depth": 3} if kind == "random_forest_regression" else {}
        result = data.analyze(kind, **extra)
        assert result.kind == kind and result.primary().count() >= 1
        result.release()
    for kind in CHARTS:
        assert data.chart(kind).count() > 0
    for fn in (analyze, chart):
        with pytest.raises(ValueError, match="Known"):
            fn(data.df(), "guess")


def test_flatten_grid_equals_ravel(spark):
    cube = np.arange(24.0).reshape(2, 3, 4)
    df = spark.createDataFrame(
        [(7, cube.ravel().tolist(), (-cube).ravel().tolist(), [10, 20], [1.0, 2.0, 3.0])],
        "tile int, temp array<double>, wind array<double>, lat array<int>, lon array<double>",
    )
    got = flatten_grid(df, {"lat": "lat", "lon": "lon", "level": [1000, 850, 500, 200]}, ["temp", "wind"], keep=["tile"])
    table = sorted(map(tuple, got.collect()))
    want = [
        (7, lat, lon, level, cube[i, j, k], -cube[i, j, k])
        for i, lat in enumerate([10, 20])
        for j, lon in enumerate([1.0, 2.0, 3.0])
        for k, level in enumerate([1000, 850, 500, 200])
    ]
    assert table == sorted(want)


def test_flatten_grid_checks_its_arguments(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(ValueError):
        flatten_grid(df, {"x": [1, 2, 3]}, [])
    with pytest.raises(Exception, match="lengths"):
        flatten_grid(df, {"x": [1, 2]}, ["v"]).collect()


def test_flatten_raster(spark):
    df = spark.createDataFrame([(1, [1.0, None, -9999.0, 4.0, float("nan"), 6.0])], "tile int, px array<double>")
    got = rows(flatten_raster(df, "px", 3, (0.5, 0, 100, 0, -0.25, 50), nodata=-9999.0), "value")
    assert got == [
        {"longitude": 100.25, "latitude": 49.875, "value": 1.0},
        {"longitude": 100.25, "latitude": 49.625, "value": 4.0},
        {"longitude": 101.25, "latitude": 49.625, "value": 6.0},
    ]
    few = rows(flatten_raster(df, "px", 3, (1, 0, 0, 0, 1, 0), max_points=2, order_by=["tile"], keep=["tile"]), "value")
    assert [r["value"] for r in few] == [1.0, 6.0]  # first and last pixel with data


def test_standardize(spark):
    df = spark.createDataFrame([(bytearray(b"caf\xc3\xa9\xff"), [1, 2], {"a": 1}, 3)], "` raw ` binary, list array<int>, map map<string,int>, n int")
    got = standardize(df)
    assert got.columns == ["raw", "list", "map", "n"]
    assert got.head().asDict() == {"raw": "café", "list": "[1,2]", "map": '{"a":1}', "n": 3}
    assert standardize(spark.range(100), max_rows=10, order_by=["id"]).count() == 10


def test_csv(spark, tmp_path):
    path = tmp_path / "obs.csv"
    path.write_text(
        'time, temp ,n,m,flag,note\n2024-01-01,1.5,1,1,True,"a, ""b"""\n2024-01-02,NA,2,,False,NULL\n2024-01-03,1e3,3,3,true,c\n'
    )
    data = Dataset.read(spark, str(path))
    types = dict(data.base.dtypes)
    assert types == {"time": "string", "temp": "double", "n": "bigint", "m": "double", "flag": "boolean", "note": "string"}
    got = rows(data.df(), "n")
    assert got[0]["note"] == 'a, "b"' and got[1]["note"] is None and got[1]["temp"] is None and got[2]["temp"] == 1000.0
    assert data.mapping.time == "time" and data.mapping.variables == ("temp",)
    assert data.source_format == "csv" and data.name == "obs.csv"


def test_formats(spark):
    assert detect_format("A/B.GRIB2") == "grib" and detect_format("x.tif") == "geotiff"
    with pytest.raises(ValueError, match=".csv"):
        detect_format("x.doc")
    with pytest.raises(ValueError, match="flatten_grid"):
        read_table(spark, "x.nc")


def test_exports(spark, frame, tmp_path):
    times = pd.date_range("2015-01-01", periods=1500)
    df = frame(pd.DataFrame({"t": times, "v": np.arange(1500.0)}))
    result = annual_trend_signal(df, "t", "v")
    export_result(result, str(tmp_path / "flat"))
    flat = spark.read.csv(str(tmp_path / "flat"), header=True)
    assert "summary.slope_per_year" in flat.columns and flat.count() == 1
    export_tables(result, str(tmp_path / "all"))
    assert spark.read.csv(str(tmp_path / "all" / "annual_series"), header=True).count() == 5
    found = anomaly_detection(df, "v", "t", z_threshold=1.7)
    assert found.primary().columns == ["time", "value", "z_score"]
    assert correlation(df.withColumn("w", F.col("v") * 2)).primary().columns == ["column", "v", "w"]
    with pytest.raises(KeyError, match="Tables"):
        result["nothing"]


def test_dataset_round_trip(spark, frame, tmp_path):
    data = Dataset.from_df(stations(frame), name="stations")
    data = data.add_recipe("air", "add_constant", "warm", constant=100)
    data = data.add_recipe("warm", "aggregate_by_day", "warm_day")
    assert data.derived_columns == ["warm", "warm_day"] and data.columns[-1] == "warm_day"
    assert "warm" in data.mapping.variables and data.mapping.column_types["warm"] == "derived_numeric"
    for bad in (("absent", "ms_to_kmh", "y"), ("air", "ms_to_kmh", "warm")):
        with pytest.raises(ValueError):
            data.add_recipe(*bad)
    assert rows(data.df(["warm_day"]).distinct(), "warm_day") == [{"warm_day": 111.5}, {"warm_day": 121.5}]
    data.write(str(tmp_path / "p"), partition_by_year=True)
    again = Dataset.read(spark, str(tmp_path / "p"), "parquet")
    assert again.df().count() == 48 and again.columns == data.columns
    assert spark.read.parquet(str(tmp_path / "p")).where("fieldstats_year = 2024").count() == 48
    data.export_csv(str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 48
    profile = rows(data.profile())[0]
    assert profile["row_count"] == 48 and profile["derived_columns"] == ["warm", "warm_day"]
    later = Dataset.from_df(spark.range(3).toDF("v"), name="later")
    assert [r["name"] for r in list_datasets(spark, [data, later]).collect()] == ["later", "stations"]
    changed = data.set_roles(time="stamp")
    assert changed.mapping.variables == ("warm", "warm_day")


def test_unused_recipes_are_not_run(frame):
    data = Dataset.from_df(stations(frame)).add_recipe("air", "aggregate_by_day", "day_mean")
    plan = data.df(["air"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_preview(spark):
    df = spark.createDataFrame([(i, float("nan") if i == 4 else float(i)) for i in range(30)], "id int, v double").repartition(4)
    data = Dataset(df, Roles(variables=("v",)))
    got = [r.asDict() for r in data.preview(["id"], 5, 3).collect()]
    assert [r["id"] for r in got] == [3, 4, 5, 6, 7] and got[1]["v"] is None
    assert data.preview(["id"], 0).count() == 1 and data.preview(["id"]).count() == 30
    with pytest.raises(ValueError):
        data.preview(["id"], 5, -1)
    with pytest.raises(ValueError):
        page(df, [], 5)


def test_streamed_days_equal_the_batch_ones(spark, frame, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stations(frame).coalesce(1).write.parquet(src)
    days = {"stamp": pd.to_datetime(["2024-02-01"]), "air": [0], "water": [0.0], "station": ["A"]}
    frame(pd.DataFrame(days), 1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    closed = stream_daily_aggregation(stream, "stamp", ["air", "water"], ["mean", "max"])
    q = (
        closed.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start(out)
    )
    q.awaitTermination(120)
    assert not q.isActive
    # The watermark has passed the two days of the first file, not the day of the last row.
    emitted = rows(spark.read.parquet(out), "period_start")
    assert [r["air_mean"] for r in emitted] == [11.5, 21.5]
    complete = stream_daily_aggregation(stream, "stamp", ["air"], ["mean"])
    q = (
        complete.writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp2")).start()
    )
    q.awaitTermination(120)
    got = rows(spark.table("days"), "period_start")
    want = rows(temporal_aggregation(spark.read.parquet(src), "stamp", ["air"], "D", ["mean"]), "period_start")
    assert got == want and len(got) == 3


def test_a_column_named_year_survives_partitioning(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 5, 1), 1901.5)], "t timestamp_ntz, year double")
    Dataset.from_df(df, name="y").set_roles(time="t", variables=["year"]).write(str(tmp_path / "y"), partition_by_year=True)
    assert [r["year"] for r in read_table(spark, str(tmp_path / "y"), "parquet").collect()] == [1901.5]
    with pytest.raises(ValueError, match="fieldstats_year"):
        write_parquet(df.withColumn("fieldstats_year", F.lit(1)), str(tmp_path / "z"), year_of="t")


def test_csv_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [(1, "two\nlines"), (2, "plain")]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|[Mm]alformed"):
        read_csv(spark, str(tmp_path / "a.csv"), "id bigint, note string", multi_line=False).collect()


def test_value_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0, 2.0), (datetime(2024, 1, 3), 3.0, 4.0)], "t timestamp_ntz, period double, `a.b``c` double")
    got = temporal_aggregation(df, "t", ["period", "a.b`c"], "D", ["mean", "count"])
    assert got.columns == ["period_start", "period_mean", "a.b`c_mean", "period_count", "a.b`c_count"]
    assert [tuple(r)[1:] for r in got.orderBy("period_start").collect()] == [(1.0, 2.0, 1, 1), (None, None, 0, 0), (3.0, 4.0, 1, 1)]


def test_times_are_read_cell_by_cell(spark):
    texts = ["unknown", *["1/1/2024"] * 20, "2024-01-02", "Jan 3, 2024", None]
    df = spark.createDataFrame([(t, 1.0) for t in texts], "t string, v double")
    got = temporal_aggregation(df, "t", ["v"], "D", ["count"])
    assert [r["v_count"] for r in got.orderBy("period_start").collect()] == [20, 1, 1]
    assert infer_roles(df).time == "t"
    assert infer_roles(spark.createDataFrame([("x",)] * 300 + [("2024-01-01",)] * 100, "t string")).time is None


def test_correlation_of_columns_that_are_incomplete(spark):
    late = spark.range(2000, numPartitions=4).selectExpr("CASE WHEN id >= 400 THEN 1.7e9 + id END AS a", "CAST(2 * id AS DOUBLE) AS b", "1.0D AS c")
    found = {(r["col_a"], r["col_b"]): r["r"] for r in correlation(late, ["a", "b", "c"])["pairs"].collect()}
    assert found["a", "b"] == found["a", "a"] == 1.0 and found["a", "c"] is None and found["c", "c"] is None
    draw = np.random.default_rng(3)
    pdf = pd.DataFrame(draw.standard_normal((100, 30)), columns=[f"v{i}" for i in range(30)]).mask(draw.random((100, 30)) < 0.2)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"v{i} double" for i in range(30)))
    want = pdf.corr()
    got = correlation(df, list(pdf.columns))["pairs"].collect()
    assert all(r["r"] == pytest.approx(want.loc[r["col_a"], r["col_b"]], abs=1e-6) for r in got)


def test_empty_lists_do_not_stand_for_a_result(frame):
    df = frame(pd.DataFrame({"t": pd.date_range("2024-01-01", periods=9), "v": [1.0, 2.0] * 4 + [1.5]}))
    assert "anomaly_count" in anomaly_detection(df, "v", "t", z_threshold=9).primary().columns
    with pytest.raises(ValueError, match="equal"):
        charts.anomaly_graph(df.withColumn("v", F.lit(1.0)), "v", "t")
    with pytest.raises(ValueError, match="at most"):
        Dataset.from_df(df, name="x").preview(["t"], 1001)


@pytest.mark.parametrize(
    ("value", "whole", "want"),
    [(None, False, 5.0), ("7.5", False, 7.5), ("x", False, 5.0), (float("nan"), False, 5.0), (99, False, 10), (-1, True, 1), ("7", True, 7), ("7.5", True, 5), (7.9, True, 7), (float("inf"), True, 5)],
)
def test_options(value, whole, want):
    assert option(value, (5.0, 1.0, 10.0), whole) == want
