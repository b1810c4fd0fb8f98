"""Plan building blocks against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldstats.functions import bins as binning
from fieldstats.plans import gram, quantiles
from fieldstats.plans.halo import lagged, rolling_mean
from fieldstats.plans.ranks import systematic_sample, takes_row
from fieldstats.plans.rowindex import with_row_index
from tests.conftest import rows


def test_row_index_is_the_sorted_position(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(5000)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(7)
    got = with_row_index(df, ["v"], partitions=5)
    assert got.where("row_index != v").count() == 0 and got.count() == 5000


def test_row_index_spreads_a_run_of_equal_keys(spark):
    # A third of the rows share one key; they must not end up in one partition.
    df = spark.range(0, 90_000, 1, 6).select(F.when(F.col("id") % 3 == 0, 10).otherwise(F.col("id")).alias("k"), "id")
    got = with_row_index(df, ["k"], partitions=6)
    assert rows(got.agg(F.count_distinct("row_index").alias("n"), F.max("row_index").alias("m"))) == [{"n": 90_000, "m": 89_999}]
    hot = got.where("k = 10").groupBy(F.spark_partition_id()).count().count()
    assert hot >= 2
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 45_000


def test_row_index_without_order_follows_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 1).write.parquet(path)
    got = with_row_index(spark.read.parquet(path))
    assert got.where("row_index != id").count() == 0


def test_row_index_of_an_empty_table(spark):
    assert with_row_index(spark.range(0).toDF("v"), ["v"]).count() == 0


@pytest.mark.parametrize("n,k", [(10, 4), (100, 7), (5000, 1000), (2399, 1000), (7, 7), (3, 10), (50, 1), (1001, 2)])
def test_systematic_sample_takes_the_linspace_rows(spark, n, k):
    df = spark.range(0, n, 1, 4).select((F.col("id") * 2).alias("v"))
    got = sorted(r["v"] // 2 for r in systematic_sample(df, k, ["v"]).collect())
    assert got == (list(range(n)) if n <= k else list(np.linspace(0, n - 1, k, dtype=int)))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(2, 3000), st.integers(2, 3000))
def test_sample_rule_equals_linspace(spark, n, k):
    if n <= k:
        n, k = k + 1, n
    taken = spark.range(n).where(takes_row(F.col("id"), n, k)).collect()
    assert sorted(r["id"] for r in taken) == list(np.linspace(0, n - 1, k, dtype=int))


def series(spark, n, seed=0, gaps=0.2):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=n)
    values[rng.random(n) < gaps] = np.nan
    pdf = pd.DataFrame({"row_index": np.arange(n), "v": values})
    df = spark.createDataFrame(pdf).select("row_index", F.when(~F.isnan("v"), F.col("v")).alias("v"))
    return pdf, df.repartition(5)


@pytest.mark.parametrize("window,block", [(1, 10), (2, 10), (7, 50), (50, 10), (50, 50), (129, 40), (300, 301), (700, 64), (2500, 100)])
def test_rolling_mean_equals_pandas(spark, window, block):
    pdf, df = series(spark, 2000, window)
    got = pd.DataFrame(rows(rolling_mean(df, F.col("v"), window, "out", block_rows=block), "row_index"))
    want = pdf.v.rolling(window, min_periods=1).mean()
    assert len(got) == 2000
    assert got.out.astype(float).to_numpy() == pytest.approx(want.to_numpy(), nan_ok=True)


def test_rolling_mean_edge_case(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, None, 3.0, None, None, None, None])], "row_index bigint, v double")
    got = [r["out"] for r in rows(rolling_mean(df, F.col("v"), 3, "out"), "row_index")]
    assert got == [1.0, 1.0, 2.0, 3.0, 3.0, None, None]


def test_rolling_plan_has_no_single_partition(spark):
    _, df = series(spark, 500)
    plan = rolling_mean(df, F.col("v"), 7, "out")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("lags,block", [(1, 10), (3, 10), (6, 4), (20, 7)])
def test_lags_equal_shift(spark, lags, block):
    pdf, df = series(spark, 400, lags)
    got = pd.DataFrame(rows(lagged(df, "v", lags, block_rows=block), "row_index"))
    assert len(got) == 400
    for k in range(1, lags + 1):
        assert got[f"lag_{k}"].astype(float).to_numpy() == pytest.approx(pdf.v.shift(k).to_numpy(), nan_ok=True)


PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@pytest.mark.parametrize("kind", ["normal", "few", "hot", "skewed", "tiny"])
@pytest.mark.parametrize("buffer", [100_000, 60])
def test_exact_quantiles(spark, kind, buffer):
    rng = np.random.default_rng(5)
    values = {
        "normal": rng.normal(size=30_000),
        "few": rng.integers(0, 4, 30_000).astype(float),
        "hot": np.where(rng.random(30_000) < 0.35, 0.123, rng.normal(size=30_000)),
        "skewed": np.exp(rng.normal(size=30_000) * 6),
        "tiny": np.array([3.0, 1.0, 2.0]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(6)
    got = quantiles.exact_quantiles(df, ["v"], PROBS, buffer)["v"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


def test_exact_quantiles_of_several_columns(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.normal(size=20_000), "b": rng.integers(0, 9, 20_000).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("c", F.lit(None).cast("double"))
    got = quantiles.exact_quantiles(df, ["a", "b", "c"], (0.25, 0.5), 50)
    assert got["c"] == [None, None]
    for c in "ab":
        assert got[c] == pytest.approx(list(pdf[c].quantile([0.25, 0.5])))


def test_fit_equals_numpy_and_survives_dependent_features(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=500), rng.normal(size=500) * 1e6
    y = 3 * a - 2e-6 * b + 5 + rng.normal(size=500) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y})).withColumn("a2", F.col("a") * 2)
    want = np.linalg.lstsq(np.column_stack([a, b, np.ones(500)]), y, rcond=None)[0]
    line = gram.fit(df, ["a", "b"], "y")
    assert (*line.coefficients, line.intercept) == pytest.approx(tuple(want), rel=1e-6)
    twin = gram.fit(df, ["a", "a2", "b"], "y")
    scored = df.withColumn("prediction", twin.predict())
    plain = df.withColumn("prediction", line.predict())
    assert rows(gram.metrics(scored, "y"))[0]["rmse"] == pytest.approx(rows(gram.metrics(plain, "y"))[0]["rmse"])


@pytest.mark.parametrize("bins", [1, 4, 10, 45])
def test_bins_equal_histogram_and_cut(spark, bins):
    rng = np.random.default_rng(bins)
    values = np.concatenate([rng.normal(size=500), np.round(rng.random(500), 1), [0.0, 1.0, 0.1, 0.3]])
    low, high = values.min(), values.max()
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    args = (F.lit(float(low)), F.lit(float(high)), bins)
    placed = df.select("v", binning.left_closed(F.col("v"), *args).alias("l"), binning.right_closed(F.col("v"), *args).alias("r")).toPandas()
    counts, _ = np.histogram(values, bins=np.linspace(low, high, bins + 1))
    assert list(np.bincount(placed.l, minlength=bins)) == list(counts)
    cut = pd.cut(placed.v, bins, labels=False)
    assert (placed.r == cut).all()


def test_bins_on_round_edges(spark):
    values = [i / 10 for i in range(11)]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = df.select(binning.left_closed(F.col("v"), F.lit(0.0), F.lit(1.0), 10).alias("b"))
    counts, _ = np.histogram(values, bins=np.linspace(0, 1, 11))
    assert list(np.bincount([r["b"] for r in got.collect()], minlength=10)) == list(counts)


def test_constant_values_are_binned(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    low, high = binning.widen_cut(F.lit(5.0), F.lit(5.0))
    got = df.select(binning.right_closed(F.col("v"), low, high, 4).alias("b"), low.alias("l"), high.alias("h")).head()
    assert got["b"] == pd.cut([5.0, 5.0], 4, labels=False)[0]
    assert (got["l"], got["h"]) == (5 - 0.005, 5 + 0.005)
    assert not math.isnan(got["l"])


def test_a_missed_bracket_is_noticed_and_replaced(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = rng.normal(size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    want = pytest.approx(list(np.quantile(values, (0.25, 0.5))))
    # A coarse sketch only aims; the result stays exact.
    monkeypatch.setattr(quantiles, "SKETCH_ITEMS", 16)
    assert quantiles.exact_quantiles(df, ["v"], (0.25, 0.5))["v"] == want
    assert quantiles.exact_quantiles(df, ["v"], (0.25, 0.5), 300)["v"] == want
    # A sketch that is wrong everywhere is noticed by the counts.
    wrong = {"n_0": 20_000, "low_0": float(values.min()), "high_0": float(values.max()), "marks_0": [9.0] * 4}
    monkeypatch.setattr(quantiles, "first_scan", lambda *a: wrong)
    assert quantiles.exact_quantiles(df, ["v"], (0.25, 0.5))["v"] == want
    assert quantiles.exact_quantiles(df, ["v"], (0.25, 0.5), 500)["v"] == want
