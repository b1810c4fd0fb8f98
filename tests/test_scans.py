"""How often plans read their table, and what runs before anything is read."""

from datetime import datetime, timedelta

import pytest

from fieldstats import Dataset, Roles
from fieldstats.operators.anomaly import anomaly_detection
from fieldstats.operators.baseline import baseline_anomalies
from fieldstats.operators.extremes import extreme_events
from fieldstats.operators.workflow import climate_workflow
from fieldstats.operators.recipes import apply_recipes, make_recipe


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "t")
    rows = [(k, datetime(2001, 1, 1) + timedelta(days=9 * k), float(k % 17)) for k in range(400)]
    spark.createDataFrame(rows, "k bigint, t timestamp_ntz, v double").write.parquet(path)
    return spark.read.parquet(path)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize(
    ("table", "most"),
    [
        (lambda df: baseline_anomalies(df, "t", "v")["summary"], 1),
        (lambda df: extreme_events(df, "t", "v")["summary"], 1),
        (lambda df: climate_workflow(df, "t", "v")["extremes"], 1),
        (lambda df: anomaly_detection(df, "v", "t")["coverage"], 2),
    ],
)
def test_summaries_read_the_table_once(stored, table, most):
    assert scans(table(stored)) == most


@pytest.mark.parametrize("chained", [False, True])
def test_calendar_recipes_share_an_aggregate(stored, chained):
    recipes, source = [], "v"
    for k, operation in enumerate(("aggregate_by_day", "aggregate_by_month", "aggregate_by_day", "aggregate_by_month")):
        recipes.append(make_recipe(source, operation, f"m{k}", Roles(time="t")))
        source = f"m{k}" if chained else "v"
    got = apply_recipes(stored, recipes, Roles(time="t"))
    assert scans(got) == 2
    rows = got.collect()
    for r in rows:
        month = [x["v"] for x in rows if (x["t"].year, x["t"].month) == (r["t"].year, r["t"].month)]
        assert r["m0"] == pytest.approx(r["v"]) and r["m1"] == pytest.approx(sum(month) / len(month))
        assert r["m3"] == pytest.approx(r["m1"]) and r["m2"] == pytest.approx(r["m1"] if chained else r["v"])


def test_recipes_that_are_not_read_do_not_run(spark, stored):
    data = Dataset.from_df(stored, Roles("t", None, None, ("v",)), name="x")
    data = data.add_recipe("v", "rolling_mean", "smooth", window=3, order_by=["k"])
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    data.input_rows()
    data.analyze("seasonal_patterns", target="v", checked=False)["monthly_pattern"]
    assert jobs() == before
    assert data.temporal_aggregation("ME", columns=["v"]).df().count() > 0
    assert data.analyze("seasonal_patterns", target="smooth", checked=False)["monthly_pattern"].count() == 12


def test_a_rolling_recipe_writes_only_what_the_analysis_reads(spark, tmp_path, monkeypatch):
    wide = spark.range(0, 1200, 1, 2).selectExpr(
        "timestamp_seconds(id * 86400) as t", "cast(id % 7 as double) as v", "id as k", *[f"id as other{i}" for i in range(20)]
    )
    data = Dataset.from_df(wide, name="x").add_recipe("v", "rolling_mean", "smooth", window=3, order_by=["k"])
    widths = []
    plain = type(wide).checkpoint
    monkeypatch.setattr(type(wide), "checkpoint", lambda df, *a, **b: widths.append(len(df.columns)) or plain(df, *a, **b))
    result = data.analyze("annual_trend_signal", target="smooth")
    assert result["annual_series"].count() == 4
    result.release()
    assert widths and max(widths) <= 4


def test_describe_reads_the_table_twice(stored, monkeypatch):
    from fieldstats.operators.describe import descriptive_stats
    from fieldstats.plans import quantiles

    passes = []
    for name in ("first_scan", "_exact_pass"):
        plain = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, plain=plain: passes.append(1) or plain(*a))
    many = stored.sparkSession.range(0, 50_000, 1, 4).selectExpr("cast(hash(id) % 1000 as double) as a", "cast(hash(id, 1) as double) as b")
    got = {r["column"]: r for r in descriptive_stats(many)["summary"].collect()}
    pdf = many.toPandas().describe()
    assert len(passes) == 2
    for c in ("a", "b"):
        assert [got[c][q] for q in ("25%", "50%", "75%")] == pytest.approx([pdf[c][q] for q in ("25%", "50%", "75%")])
