"""The driver contract on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from compare import keyed

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["year", "mean", "std", "min", "max", "count", "trend"] and got.count() == 7


@pytest.mark.parametrize("missing", ["regex", "xxhash", "public_tokenizers", "llm"])
def test_other_queries_stay_if_a_package_of_the_operators_is_missing(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None  # any import of it fails
import __spark_entry__ as contract
assert "annual_trend_signal" in contract.queries() and "pipeline" not in contract.queries()
assert not [name for name in contract.queries() if name.startswith("op1_")]
assert set(contract.oracle_sql()) <= set(contract.queries())
"""
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=os.path.dirname(contract.__file__))


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize(
    "name",
    ["annual_trend_signal", "temporal_agg_gapfill", "describe_stats", "diurnal_season_hour", "baseline_annual_anomalies",
     "extreme_annual", "decadal_hist", "workflow_preview", "recipe_rolling_mean", "spatial_grid", "systematic_sample_rows",
     "csv_round_trip", "parquet_by_year", "export_primary", "capped_ingest", "raster_capped", "recipe_suggest", "override_roles", "readable_times", "preview_limits",
     "zscore_listing_text", "infer_roles_ranges", "infer_roles_text", "forest_net_price", "forecast_six_lags"],
)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    got = contract.queries()[name](spark, FOLDER)
    answer = db.execute(contract.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(got.columns)
    assert keyed(got.columns, [tuple(r) for r in got.collect()]) == keyed(names, answer.fetchall())
