"""Text times against all listed patterns tried one after the other."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats import Dataset, Roles, fixed
from fieldstats.functions.coerce import time_expr
from fieldstats.operators.aggregate import temporal_aggregation


def plain(column):
    return F.coalesce(column.try_cast("timestamp"), *[F.try_to_timestamp(column, F.lit(p)) for p in fixed.DATETIME_PATTERNS])


def cells():
    rng = random.Random(6)
    months = ["Jan", "January", "May", "June", "Sep", "Sept", "September", "december", "Dec"]
    out = [None, "", " ", "abc", "2024", "20240131", "20240231", "20240131235959", "1/2/2024", "13/25/2024", "003/05/2024", "1/2/2024 3:04", "1/2/2024 25:04:05"]
    out += ["2024/1/31", "2024/1/31 7:08:09", "2024-01-31T10:11:12", "2024-01-31", "1-Feb-2024", "01-Feb-24", "1/2/20245", "12/31/1999 23:59:59", "x1/2/2024", "1/2/2024 "]
    for _ in range(400):
        d, m, y = rng.randint(0, 35), rng.choice(months), rng.choice([1999, 2024, 24, 20240])
        out += [f"{m} {d} {y}", f"{m} {d}, {y}", f"{d} {m} {y}", f"{d}-{m}-{y}", f"{d:02d}/{d % 14}/{y}", f"{y}/{d % 14}/{d} {d % 26}:{d:02d}", f"{y}{d:02d}{d % 14:02d}"]
    return out


def test_shapes_leave_the_results_alone(spark):
    df = spark.createDataFrame([(c,) for c in cells()], "c string")
    got = df.select("c", F.unix_micros(time_expr(F.col("c"), T.StringType())).alias("a"), F.unix_micros(plain(F.col("c"))).alias("b")).collect()
    assert [(r["c"], r["a"]) for r in got] == [(r["c"], r["b"]) for r in got]
    assert sum(r["a"] is not None for r in got) > 500


def test_resampling_without_a_readable_time_raises(spark):
    df = spark.createDataFrame([("never", 1.0), (None, 2.0)], "t string, v double")
    with pytest.raises(ValueError, match="'t' holds no readable time"):
        temporal_aggregation(df, "t", ["v"])
    assert temporal_aggregation(df, "t", ["v"], verify=False).count() == 0
    with pytest.raises(ValueError, match="readable time"):
        Dataset(df, Roles(time="t", variables=("v",))).temporal_aggregation("D")
