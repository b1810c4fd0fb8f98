"""Rows by rank against a sorted list."""

import datetime as dt
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstats.plans import ranks
from fieldstats.sources.sinks import page


def key(value):
    """Null first, NaN last."""
    return (value is not None, isinstance(value, float) and value != value, value if value is not None and value == value else 0)


def picked(df, order, first, count, columns):
    got = ranks.ranked_between(df, order, first, count).select(*columns).collect()
    return sorted((tuple(r) for r in got), key=lambda r: tuple(map(key, r)))


@pytest.fixture
def crowded(monkeypatch):
    monkeypatch.setattr(ranks, "_CROWDED", 20)


def check(spark, rows, schema, columns, cells=16):
    df = spark.createDataFrame(rows, schema).repartition(5)
    want = sorted((tuple(r) for r in rows), key=lambda r: tuple(map(key, r)))
    for first, count in [(0, 3), (len(rows) // 3, 40), (len(rows) - 2, 10), (len(rows) + 5, 3)]:
        got = picked(df, columns, first, count, columns)
        assert list(map(repr, got)) == list(map(repr, want[first : first + count]))


def test_doubles_with_nulls_and_extremes(spark, crowded):
    rng = random.Random(1)
    special = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1e308, -1e308, 5e-324]
    rows = [(rng.choice([*special, rng.gauss(0, 1), rng.gauss(0, 1e-9)]), i) for i in range(900)]
    check(spark, rows, "v double, i long", ["v", "i"])


def test_a_third_of_the_rows_in_one_key(spark, crowded):
    rows = [(7 if i % 3 else i, None if i % 5 == 0 else f"t{i % 4}", i) for i in range(1200)]
    check(spark, rows, "a long, b string, i long", ["a", "b", "i"])


def test_texts_with_long_common_beginnings(spark, crowded):
    rng = random.Random(2)
    rows = [("x" * rng.choice([0, 5, 23, 24, 40]) + "".join(rng.choice(string.ascii_letters + "é\U0001f642") for _ in range(rng.randint(0, 3))), i) for i in range(800)]
    df = spark.createDataFrame(rows, "s string, i long").repartition(4)
    want = sorted(rows, key=lambda r: (r[0].encode(), r[1]))
    got = ranks.ranked_between(df, ["s", "i"], 300, 100).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0].encode(), r[1])) == want[300:400]


def test_times_dates_and_booleans(spark, crowded):
    start = dt.datetime(2020, 10, 25)
    rows = [(start + dt.timedelta(minutes=17 * (i % 400)), dt.date(2000, 1, 1) + dt.timedelta(days=i % 7), i % 2 == 0, i) for i in range(900)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # has an hour twice that night
    try:
        check(spark, rows, "t timestamp_ntz, d date, b boolean, i long", ["t", "d", "b", "i"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sample_of_rows_alike_in_all_keys(spark, crowded):
    df = spark.range(0, 1000, 1, 4).select(F.lit(1).alias("k"), "id")
    got = sorted(r["id"] for r in ranks.systematic_sample(df, 50, ["k"]).collect())
    assert got == list(np.linspace(0, 999, 50, dtype=int))
    without = sorted(r["id"] for r in ranks.systematic_sample(df, 50).collect())
    assert without == got


def test_sample_writes_nothing_and_shuffles_only_its_cells(spark, tmp_path, monkeypatch):
    spark.range(0, 100_000, 1, 4).withColumn("wide", F.repeat(F.lit("x"), 50)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(type(df), "checkpoint", None)
    out = ranks.systematic_sample(df, 20, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "rangepartitioning" not in plan
    assert sorted(r["id"] for r in out.collect()) == list(np.linspace(0, 99_999, 20, dtype=int))
    held = ranks.Ranks(df, ["id"], lambda start, rows, total: start <= 50_000 < start + rows)
    assert held.rows("r").count() < 100


def test_empty_and_nested_types(spark):
    assert ranks.ranked_between(spark.range(0), ["id"], 0, 5).count() == 0
    assert ranks.systematic_sample(spark.range(0), 5, ["id"]).count() == 0
    df = spark.range(0, 50, 1, 3).select(F.array("id").alias("a"))
    assert sorted(r["a"][0] for r in ranks.ranked_between(df, ["a"], 10, 5).collect()) == [10, 11, 12, 13, 14]


def test_pages_by_offset_and_by_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1.5, 2.5, float("nan")]), i, f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "`a.b` double, i long, v string").repartition(3)
    want = [r[1] for r in sorted(rows, key=lambda r: (key(r[0]), r[1]))]
    seen, after = [], None
    while True:
        part = page(df, ["a.b", "i"], 70, after=after).collect()
        if not part:
            break
        seen += [r["i"] for r in part]
        last = next(r for r in rows if r[1] == part[-1]["i"])
        after = [last[0], last[1]]
    assert seen == want
    for offset in (0, 1, 137, 290, 300, 999):
        assert [r["i"] for r in page(df, ["a.b", "i"], 25, offset).collect()] == want[offset : offset + 25]
    with pytest.raises(ValueError, match="after"):
        page(df, ["a.b", "i"], 5, after=[1])
