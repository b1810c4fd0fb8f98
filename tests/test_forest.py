import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldstats.operators.models import random_forest_regression
from fieldstats.plans import forest


def plain_tree(x, y, depth=None):
    """Greedy splits one node at a time; returns predictions of its own rows and the error taken away by feature."""
    out, gains = np.empty(len(y)), np.zeros(x.shape[0])

    def node(rows, level):
        sse = ((y[rows] - y[rows].mean()) ** 2).sum()
        best = (-1.0, None, None)
        for f in range(x.shape[0]):
            for cut in np.unique(x[f, rows])[:-1]:
                a, b = rows[x[f, rows] <= cut], rows[x[f, rows] > cut]
                gain = sse - ((y[a] - y[a].mean()) ** 2).sum() - ((y[b] - y[b].mean()) ** 2).sum()
                if gain > best[0]:
                    best = (gain, f, cut)
        if best[1] is None or sse < 1e-12 or (depth is not None and level >= depth):
            out[rows] = y[rows].mean()
            return
        gains[best[1]] += best[0]
        left = x[best[1], rows] <= best[2]
        node(rows[left], level + 1)
        node(rows[~left], level + 1)

    node(np.arange(len(y)), 0)
    return out, gains


@pytest.mark.parametrize("depth", [None, 1, 3])
def test_tree_equals_greedy_splits(depth):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, (3, 120)).astype(np.uint16)
    y = rng.normal(size=120) + x[0]
    tree = forest.grow(x, y, 1, depth)
    want, gains = plain_tree(x, y, depth)
    if depth is None:
        assert np.allclose(tree.predict(x), want)  # ties of the last splits may fall on any feature
        assert tree.gains.sum() == pytest.approx(gains.sum())
    else:
        assert np.allclose(tree.predict(x), want) and np.allclose(tree.gains, gains)


def test_constant_target_and_features():
    x = np.array([[1, 2, 3], [5, 5, 5]], np.uint16)
    assert len(forest.grow(x, np.full(3, 2.0), 1).value) == 1
    same = forest.grow(np.ones((2, 4), np.uint16), np.array([1.0, 2.0, 3.0, 4.0]), 1)
    assert list(same.predict(np.ones((2, 1), np.uint16))) == [2.5]


def test_equal_features_share_the_importance(spark):
    rng = np.random.default_rng(3)
    a = rng.random(400)
    pdf = pd.DataFrame({"a": a, "b": a, "y": a + 0.3 * rng.random(400)})
    grown = forest.fit(spark.createDataFrame(pdf), ["a", "b"], "y", trees=20)
    assert sum(grown.importances()) == pytest.approx(1)
    assert 0.3 < grown.importances()[0] < 0.7


def test_bags_draw_with_replacement_and_are_bounded(spark, monkeypatch):
    seen = spark.range(5000).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    sizes = {}
    for most in (16_384, 500):
        grown = forest.fit(seen, ["x"], "y", trees=8, bag_rows=most, max_bins=50_000)
        sizes[most] = [int((t.left == 0).sum()) for t in grown.trees]
        assert len(grown.trees) == 8
    assert all(3000 < n < 3320 for n in sizes[16_384])  # 1 - 1/e of the rows occur
    assert all(380 < n < 620 for n in sizes[500])


def test_chances_are_poisson():
    for rate in (0.01, 3.0, 200.0):
        total = forest._poisson(rate)
        p = np.diff(np.r_[0.0, total])
        k = np.arange(len(p))
        assert total[-1] == pytest.approx(1, abs=1e-12)
        assert (p * k).sum() == pytest.approx(rate) and (p * (k - rate) ** 2).sum() == pytest.approx(rate)


def test_deep_forest_follows_an_interaction(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.random((4000, 3)), columns=["a", "b", "odd.name"])
    pdf["y"] = np.sign(pdf.a - 0.5) * np.sign(pdf.b - 0.5)
    df = spark.createDataFrame(pdf).repartition(5)
    first = random_forest_regression(df, "y", ["a", "b", "odd.name"], n_estimators=30, held_out=F.col("a") < 0.2)
    score = first["coverage"].first()
    assert score["r2"] > 0.95 and score["test_points"] == int((pdf.a < 0.2).sum())
    assert first["predictions"].columns == ["a", "b", "odd.name", "y", "prediction"]
    weights = {r["feature"]: r["importance"] for r in first["feature_importance"].collect()}
    assert weights["odd.name"] < 0.05


def test_registered_forest_ends(spark):
    from registered import queries

    rows = queries.QUERIES["forest_importance"](spark, "/root/testdata/sf0.001").collect()
    assert [r["feature"] for r in rows] == ["l_quantity", "l_discount", "l_tax"]
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
