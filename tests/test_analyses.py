"""Analyses on small series whose results are known by construction."""

import numpy as np
import pandas as pd
import pytest

from fieldstats.operators.anomaly import anomaly_detection
from fieldstats.operators.baseline import baseline_anomalies
from fieldstats.operators.climatology import diurnal_cycle, seasonal_patterns
from fieldstats.operators.describe import descriptive_stats
from fieldstats.operators.distribution import decadal_distributions
from fieldstats.operators.extremes import extreme_events
from fieldstats.operators.relate import correlation
from fieldstats.operators.trend import annual_trend_signal, trend_detection
from fieldstats.operators.workflow import climate_workflow
from fieldstats import Roles
from tests.conftest import rows


def daily(start, end, fn):
    times = pd.date_range(start, end, freq="D")
    return pd.DataFrame({"stamp": times, "moisture": [float(fn(i, t)) for i, t in enumerate(times)]})


def test_descriptive_stats(frame):
    pdf = pd.DataFrame(
        {
            "time": pd.date_range("2024-01-01", periods=12),
            "temperature": [12.0, 12.4, 13.1, 11.9, 12.8, 13.3, 14.0, 14.2, 13.7, 14.6, 15.0, 15.1],
            "precipitation": [0.0, 1.2, 0.4, 0.0, 2.5, 3.1, 0.0, 0.2, 0.0, 4.4, 1.0, 0.6],
            "label": list("abcdefghijkl"),
        }
    )
    got = {r["column"]: r for r in rows(descriptive_stats(frame(pdf))["summary"])}
    expected = pdf[["temperature", "precipitation"]].describe().round(6)
    assert set(got) == {"temperature", "precipitation"}
    for column, want in expected.items():
        for stat, value in want.items():
            assert got[column][stat] == pytest.approx(value, abs=1e-6)


def test_descriptive_stats_of_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {r["column"]: r for r in rows(descriptive_stats(df)["summary"])}
    assert got["b"]["count"] == 0 and got["b"]["50%"] is None
    assert got["a"]["50%"] == 1.5


def test_seasonal_patterns(frame):
    times = pd.date_range("2022-01-01", "2023-12-01", freq="MS")
    df = frame(pd.DataFrame({"stamp": times, "moisture": [t.month * 2.0 for t in times]}))
    result = seasonal_patterns(df, "stamp", "moisture", checked=True)
    months = rows(result["monthly_climatology"], "month")
    assert [m["month"] for m in months] == list(range(1, 13))
    assert months[6]["mean"] == 14.0 and months[6]["month_label"] == "Jul"
    assert len(rows(result["seasonal_cycle"])) == 4
    summary = rows(result["summary"])[0]
    assert (summary["warmest_month_label"], summary["coolest_month_label"]) == ("Dec", "Jan")
    assert summary["seasonal_range"] == 22.0
    quality = rows(result["data_quality"])[0]
    assert quality["observed_months"] == 12 and quality["complete_12_month_profile"]
    result.release()


def test_seasons_without_rows_are_listed(frame):
    times = pd.date_range("2024-01-01", "2024-01-20")
    df = frame(pd.DataFrame({"t": times, "v": np.arange(20.0)}))
    result = seasonal_patterns(df, "t", "v")
    cycle = {r["season"]: r for r in rows(result["seasonal_cycle"])}
    assert cycle["winter"]["count"] == 20 and cycle["summer"] == {
        "season": "summer", "mean": None, "std": None, "min": None, "max": None, "count": 0,
    }
    assert len(rows(result["monthly_pattern"])) == 1
    assert cycle["winter"]["std"] == pytest.approx(np.arange(20.0).std(ddof=1))


def test_merged_moments_equal_direct_ones(frame):
    rng = np.random.default_rng(3)
    times = pd.date_range("2000-01-01", periods=3000, freq="7h")
    values = 1e9 + rng.normal(size=3000)
    got = {r["season"]: r for r in rows(seasonal_patterns(frame(pd.DataFrame({"t": times, "v": values})), "t", "v")["seasonal_cycle"])}
    names = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer", 8: "summer"}
    for season, group in pd.Series(values).groupby([names.get(m, "autumn") for m in times.month]):
        assert got[season]["std"] == pytest.approx(group.std(), rel=1e-6)
        assert got[season]["count"] == len(group)


def test_diurnal_cycle(frame):
    times, values = [], []
    for k, month in enumerate((1, 4, 7, 10)):
        for hour in range(24):
            times.append(pd.Timestamp(2024, month, 15, hour))
            values.append(10.0 * k + hour)
    df = frame(pd.DataFrame({"stamp": times, "air": values}))
    result = diurnal_cycle(df, "stamp", "air", checked=True)
    hours = rows(result["hourly_profile"], "hour")
    assert len(hours) == 24 and hours[23]["mean"] == 38.0
    assert len(rows(result["seasonal_hourly_profile"])) == 96
    summary = rows(result["summary"])[0]
    assert (summary["warmest_hour"], summary["coolest_hour"], summary["diurnal_range"]) == (23, 0, 23.0)
    assert {p["season"]: p["warmest_hour"] for p in rows(result["seasonal_peaks"])} == dict.fromkeys(
        ["winter", "spring", "summer", "autumn"], 23
    )


def test_diurnal_offset_moves_hour_and_season(frame):
    df = frame(pd.DataFrame({"t": pd.to_datetime(["2024-02-29 23:00", "2024-02-29 10:00", "2024-02-29 11:45"]), "v": [1.0, 2.0, 3.0]}), 1)
    result = diurnal_cycle(df, "t", "v", timezone_offset_hours=1.5)
    seen = {(r["season"], r["hour"]) for r in rows(result["seasonal_hourly_profile"]) if r["count"]}
    assert seen == {("spring", 0), ("winter", 11), ("winter", 13)}


def test_diurnal_needs_two_hours(frame):
    df = frame(pd.DataFrame({"t": pd.date_range("2024-01-01", periods=5), "v": np.arange(5.0)}))
    with pytest.raises(ValueError, match="hours"):
        diurnal_cycle(df, "t", "v", checked=True)


def test_annual_trend_signal(frame):
    df = frame(daily("2019-01-01", "2023-12-31", lambda i, t: 20 + (t.year - 2019) * 0.25 + t.dayofyear / 366))
    result = annual_trend_signal(df, "stamp", "moisture", checked=True)
    assert len(rows(result["annual_series"])) == 5
    summary = rows(result["summary"])[0]
    assert summary["trend_direction"] == "increasing" and summary["slope_per_decade"] > 0
    assert (summary["lowest_year"], summary["highest_year"]) == (2019, 2023)
    coverage = rows(result["coverage"])[0]
    assert coverage["daily_periods"] == 1826 and coverage["annual_periods"] == 5
    years = np.array([r["year"] for r in rows(result["annual_series"], "year")])
    means = np.array([r["mean"] for r in rows(result["annual_series"], "year")])
    fit = np.polyfit(years, means, 1)
    assert [r["trend"] for r in rows(result["annual_series"], "year")] == pytest.approx(np.polyval(fit, years))


def test_annual_trend_needs_three_years(frame):
    df = frame(daily("2019-01-01", "2020-12-31", lambda i, t: i))
    with pytest.raises(ValueError, match="years"):
        annual_trend_signal(df, "stamp", "moisture", checked=True)
    assert rows(annual_trend_signal(df, "stamp", "moisture")["summary"])[0]["slope_per_year"] is None


def test_trend_detection_is_a_least_squares_line(frame):
    times = pd.date_range("2024-01-01", periods=200, freq="h")
    values = np.sin(np.arange(200)) + np.arange(200) * 0.01
    result = trend_detection(frame(pd.DataFrame({"t": times, "v": values})), "t", "v", checked=True)
    x = times.astype("int64") / 1e9 if times.dtype == "datetime64[ns]" else times.astype("datetime64[ns]").astype("int64") / 1e9
    slope, intercept = np.polyfit(x - x[0], values, 1)
    fit = rows(result["fit"])[0]
    assert fit["slope_per_second"] == pytest.approx(slope, rel=1e-8)
    assert fit["trend_direction"] == "increasing"
    points = rows(result["points"], "time")
    assert [p["fitted"] for p in points] == pytest.approx(slope * (x - x[0]) + intercept, rel=1e-5)


def test_trend_target_follows_hints(frame):
    pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=4), "wind": [1.0, 2, 3, 4], "rain_mm": [4.0, 3, 2, 1]})
    known = Roles(time="t", variables=("wind", "rain_mm"))
    assert trend_detection(frame(pdf), roles=known, kind="precipitation_trend").info["target_column"] == "rain_mm"
    assert trend_detection(frame(pdf), roles=known, kind="temperature_trend").info["target_column"] == "wind"


def test_baseline_anomalies(frame):
    df = frame(daily("2019-01-01", "2023-12-31", lambda i, t: t.month * 10 + (t.year - 2019) * 0.5))
    result = baseline_anomalies(
        df, "stamp", "moisture", baseline_start="2020-01-01", baseline_end="2021-12-31", checked=True
    )
    assert all(m["baseline"] is not None for m in rows(result["monthly_baseline"]))
    years = rows(result["annual_anomalies"], "year")
    assert len(years) == 5 and years[0]["anomaly"] == pytest.approx(-0.75, abs=1e-3)  # February 2020 has a day more
    summary = rows(result["summary"])[0]
    assert summary["most_negative_year"] == 2019 and summary["most_negative_anomaly"] < 0
    assert summary["most_positive_year"] == 2023 and summary["most_positive_anomaly"] > 0
    assert (summary["negative_years"], summary["positive_years"]) == (2, 3)
    assert rows(result["baseline"])[0]["used_requested_period"]


def test_baseline_without_match_uses_everything(frame):
    df = frame(daily("2019-01-01", "2020-12-31", lambda i, t: t.month))
    for dates in ({"baseline_start": "1950-01-01", "baseline_end": "1951-01-01"}, {"baseline_start": "not a date"}):
        facts = rows(baseline_anomalies(df, "stamp", "moisture", **dates)["baseline"])[0]
        assert not facts["used_requested_period"] and facts["periods"] == 731


def test_climate_normal_is_used_when_covered(frame):
    df = frame(daily("1990-01-01", "2021-12-31", lambda i, t: t.year))
    facts = rows(baseline_anomalies(df, "stamp", "moisture")["baseline"])[0]
    assert facts["used_requested_period"] and facts["requested_start"] == "1991-01-01"
    assert str(facts["start"])[:10] == "1991-01-01" and str(facts["end"])[:10] == "2020-12-31"
    short = frame(daily("1995-01-01", "2021-12-31", lambda i, t: t.year))
    facts = rows(baseline_anomalies(short, "stamp", "moisture")["baseline"])[0]
    assert not facts["used_requested_period"] and facts["requested_start"] is None


def test_months_outside_the_baseline(frame):
    df = frame(daily("2019-01-01", "2020-06-30", lambda i, t: t.month))
    span = {"baseline_start": "2020-01-01", "baseline_end": "2020-03-31"}
    strict = rows(baseline_anomalies(df, "stamp", "moisture", **span)["annual_anomalies"], "year")
    assert [y["count"] for y in strict] == [90, 91]
    only_summer = {"baseline_start": "2019-07-01", "baseline_end": "2019-08-31"}
    kept = rows(climate_workflow(df, "stamp", "moisture", **only_summer)["annual_anomalies"], "year")
    assert [y["year"] for y in kept] == [2019, 2020] and kept[1]["anomaly"] is None


def test_extreme_events(frame):
    df = frame(daily("2019-01-01", "2023-12-31", lambda i, t: (t.year - 2019) * 2 + t.dayofyear / 366))
    result = extreme_events(df, "stamp", "moisture", high_quantile=0.8, low_quantile=0.2, checked=True)
    summary = rows(result["summary"])[0]
    assert summary["high_trend_per_decade"] > 0 > summary["low_trend_per_decade"]
    assert (summary["max_high_year"], summary["max_low_year"]) == (2023, 2019)
    assert len(rows(result["annual_extremes"])) == 5
    with pytest.raises(ValueError, match="below"):
        extreme_events(df, "stamp", "moisture", high_quantile=0.5, low_quantile=0.5)


def test_extreme_trend_is_null_under_three_years(frame):
    df = frame(daily("2019-01-01", "2020-12-31", lambda i, t: i))
    assert all(r["high_trend"] is None for r in rows(extreme_events(df, "stamp", "moisture")["annual_extremes"]))


def test_decadal_distributions(frame):
    pdf = daily("1990-01-01", "2019-12-31", lambda i, t: (t.year // 10) * 10 - 1990 + t.dayofyear / 366)
    result = decadal_distributions(frame(pdf), "stamp", "moisture", bins=20, checked=True)
    stats = rows(result["decadal_statistics"], "decade")
    assert [s["label"] for s in stats] == ["1990s", "2000s", "2010s"]
    assert rows(result["summary"])[0]["mean_shift_first_to_last"] > 0
    histograms = rows(result["decadal_histograms"])
    assert len(histograms) == 60
    edges = np.linspace(pdf.moisture.min(), pdf.moisture.max(), 21)
    for start, group in pdf.groupby((pdf.stamp.dt.year // 10) * 10):
        own = sorted((h for h in histograms if h["decade"] == start), key=lambda h: h["bin"])
        density, _ = np.histogram(group.moisture, bins=edges, density=True)
        assert [h["density"] for h in own] == pytest.approx(density)
        assert [own[0]["left"], *[h["right"] for h in own]] == pytest.approx(edges)
        q = group.moisture.quantile([0.05, 0.25, 0.5, 0.75, 0.95])
        got = next(s for s in stats if s["decade"] == start)
        assert [got[c] for c in ("q05", "q25", "median", "q75", "q95")] == pytest.approx(list(q))
    steps = [s for s in rows(result["histogram_steps"], "step") if s["decade"] == 1990]
    assert len(steps) == 40 and steps[0]["x"] == pytest.approx(edges[0]) and steps[-1]["x"] == pytest.approx(edges[-1])


def test_histogram_of_a_constant(frame):
    df = frame(daily("2000-01-01", "2000-01-20", lambda i, t: 7))
    histograms = rows(decadal_distributions(df, "stamp", "moisture", bins=10)["decadal_histograms"], "bin")
    assert histograms[0]["left"] == 6.5 and histograms[-1]["right"] == 7.5
    assert [h["count"] for h in histograms] == list(np.histogram([7.0] * 20, bins=np.linspace(6.5, 7.5, 11))[0])


def test_options_are_moved_into_their_bounds(frame):
    df = frame(daily("2000-01-01", "2000-01-20", lambda i, t: i))
    assert decadal_distributions(df, "stamp", "moisture", bins=5000).info["bins"] == 100
    assert decadal_distributions(df, "stamp", "moisture", bins="many").info["bins"] == 50
    assert diurnal_cycle(df, "stamp", "moisture", timezone_offset_hours=99).info["timezone_offset_hours"] == 14.0


def test_climate_workflow(frame):
    df = frame(daily("2019-01-01", "2022-12-31", lambda i, t: 35 + i / 365 * 0.4 + 8 * ((t.dayofyear % 365) / 365)))
    result = climate_workflow(
        df, "stamp", "moisture", baseline_start="2020-01-01", baseline_end="2021-12-31", checked=True, preview_rows=1000
    )
    assert rows(result["coverage"])[0]["aggregated_periods"] == 1461
    assert len(rows(result["monthly_climatology"])) == 12
    assert rows(result["annual_trend"])[0]["slope_per_decade"] is not None
    extremes = rows(result["extremes"])[0]
    assert extremes["high_threshold"] > extremes["low_threshold"]
    assert rows(result["baseline"])[0]["used_requested_period"]
    assert [r["season"] for r in rows(result["seasonal_cycle"])] == ["winter", "spring", "summer", "autumn"]
    preview = rows(result["aggregated_preview"], "time")
    keep = np.linspace(0, 1460, 1000, dtype=int)
    times = pd.date_range("2019-01-01", "2022-12-31")
    assert [p["time"] for p in preview] == [t.to_pydatetime() for t in times[keep]]


def test_result_tables_share_one_scan(frame):
    result = climate_workflow(frame(daily("2019-01-01", "2022-12-31", lambda i, t: i)), "stamp", "moisture", checked=True)
    plan = result["monthly_climatology"]._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    result.release()


def test_unusable_cells_are_counted(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "1"), ("2024-01-02", "x"), (None, "2"), ("nonsense", "3"), ("2024-01-03", "NaN"), ("2024-01-04", " 4 ")],
        "t string, v string",
    )
    coverage = rows(annual_trend_signal(df, "t", "v")["coverage"])[0]
    assert (coverage["source_rows"], coverage["valid_rows"]) == (6, 2)
    assert (coverage["missing_time"], coverage["missing_target"]) == (2, 2)


def test_correlation_is_pairwise(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, 1.0), (2.0, 5.0, None), (3.0, 5.0, 2.0), (None, 5.0, 3.0)], "a double, b double, c double"
    )
    pairs = {(r["col_a"], r["col_b"]): r["r"] for r in rows(correlation(df)["pairs"])}
    assert pairs["a", "c"] == 1.0 and pairs["c", "a"] == 1.0 and pairs["a", "a"] == 1.0
    assert all(pairs[k] is None for k in pairs if "b" in k)
    matrix = {r["column"]: r for r in rows(correlation(df)["matrix"])}
    assert matrix["a"]["c"] == 1.0 and matrix["b"]["b"] is None
    with pytest.raises(ValueError):
        correlation(df, ["a"])


def test_anomaly_detection(spark):
    values = [1.0] * 50 + [100.0] + [None] + [1.0] * 20
    df = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", v) for i, v in enumerate(values)], "id int, t string, v double")
    result = anomaly_detection(df, "v", "t", order_by=["id"], checked=True)
    found = rows(result["anomalies"])
    present = np.array([v for v in values if v is not None])
    assert len(found) == 1 and found[0]["id"] == 50
    assert found[0]["z_score"] == pytest.approx((100 - present.mean()) / present.std())
    assert rows(result["coverage"])[0]["anomaly_count"] == 1


def test_anomaly_listing_keeps_unreadable_times_and_stops_at_its_limit(spark):
    df = spark.createDataFrame([(i, "noon" if i % 2 else "2024-01-01", float(i % 2)) for i in range(20)], "id int, t string, v double")
    result = anomaly_detection(df, "v", "t", z_threshold=0.5, order_by=["id"], limit=6)
    listed = rows(result["anomalies"])
    assert [r["id"] for r in listed] == list(range(6)) and {r["time"] for r in listed} == {"noon", "2024-01-01T00:00:00"}
    assert rows(result["coverage"])[0]["anomaly_count"] == 20 and result["all_anomalies"].count() == 20


def test_constant_values_have_no_anomalies(spark):
    df = spark.createDataFrame([(5.0,)] * 5, "v double")
    with pytest.raises(ValueError, match="zero"):
        anomaly_detection(df, "v", checked=True)
    assert rows(anomaly_detection(df, "v")["anomalies"]) == []


def test_ties_go_to_the_earlier_key(frame):
    pdf = pd.DataFrame({"t": pd.to_datetime(["2024-01-05", "2024-02-05", "2024-03-05", "2024-04-05"]), "v": [2.0, 9.0, 9.0, 2.0]})
    summary = rows(seasonal_patterns(frame(pdf), "t", "v")["summary"])[0]
    assert (summary["warmest_month"], summary["coolest_month"]) == (2, 1)
