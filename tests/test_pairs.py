import time

import numpy as np
import pandas as pd
import pytest

from fieldstats.operators.relate import correlation_pairs
from fieldstats.plans import pairs


def found(df, columns):
    return {(r["col_a"], r["col_b"]): r["r"] for r in correlation_pairs(df, columns, None).collect()}


def equal(got, pdf, tolerance=1e-9):
    want = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            w = want.loc[a, b]
            assert got[a, b] is None if np.isnan(w) else got[a, b] == pytest.approx(w, abs=tolerance), (a, b)


def incomplete(rows, columns, seed=1, missing=0.3):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(rows, columns)) + rng.normal(size=(rows, 1))
    values[rng.random((rows, columns)) < missing] = np.nan
    return pd.DataFrame(values, columns=[f"v{i}" for i in range(columns)])


def frame_of(spark, pdf, parts=4):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(parts)


def test_thirty_incomplete_columns(spark):
    pdf = incomplete(2000, 30)
    df = frame_of(spark, pdf).cache()
    df.count()
    found(df, list(pdf.columns[:2]))
    started = time.time()
    got = found(df, list(pdf.columns))
    assert time.time() - started < 15  # 80 with an aggregate a pair
    equal(got, pdf)


def test_constant_within_a_pair_only(spark):
    # a varies, but not where b is present; c is constant; d has one value; e is far from its mean with b
    pdf = pd.DataFrame(
        {
            "a": [0.1, 0.1, 0.1, 5.0, 6.0, 7.0],
            "b": [1.0, 2.0, 4.0, np.nan, np.nan, np.nan],
            "c": [0.3] * 6,
            "d": [1.0, *[np.nan] * 5],
            "e": [1e9, 1e9 + 1, 1e9 + 3, -1e9, -1e9, -1e9],
        }
    )
    got = found(frame_of(spark, pdf, 3), list(pdf.columns))
    for pair in [("a", "b"), ("a", "c"), ("c", "c"), ("d", "d"), ("a", "d"), ("b", "d")]:
        assert got[pair] is None and got[pair[::-1]] is None
    assert got["b", "e"] == pytest.approx(np.corrcoef([1, 2, 4], [0, 1, 3])[0, 1], abs=1e-9)
    assert got["a", "a"] == 1 and got["e", "e"] == 1


def test_no_common_rows_and_no_rows(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, np.nan, np.nan], "b": [np.nan, np.nan, 1.0, 2.0]})
    got = found(frame_of(spark, pdf), ["a", "b"])
    assert got["a", "b"] is None and got["a", "a"] == 1
    empty = spark.createDataFrame([], "a double, b double")
    assert set(found(empty, ["a", "b"]).values()) == {None}


def test_one_scan_for_all_pairs(spark, tmp_path):
    pdf = incomplete(50, 40, seed=5)
    frame_of(spark, pdf).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = pairs.pair_sums(df, np.zeros(40))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1
    equal(found(df, list(pdf.columns)), pdf)
