import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import whitening
from llm.queries import op11_whitened_components

from .helpers import CLASHING, table

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(vectors, most=32):
    """Eigenvectors of the whole covariance matrix."""
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    whole = n * x - x.sum(axis=0)
    c = whole / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    return n, (whole.astype(object) ** 2).sum(axis=1), c @ axes / np.sqrt(e), e / (c * c).sum() * n


def found(df, r):
    out = {}
    for row in df.collect():
        out.setdefault(row["vec_id"], {})[row["component"]] = row
    assert all(sorted(v) == list(range(1, r + 1)) for v in out.values())
    return out


def check(df, ids, vectors, most=32):
    n, deviation, projected, share = plain(vectors, most)
    r = projected.shape[1]
    got = found(df, r)
    assert sorted(got) == sorted(ids)
    w = np.array([[got[i][k + 1]["whitened"] for k in range(r)] for i in ids])
    sign = np.sign((w * projected).sum(axis=0))
    assert np.abs(w - projected * sign).max() < 1e-7
    assert [int(got[i][1]["deviation"]) for i in ids] == list(deviation)
    assert np.allclose([got[ids[0]][k + 1]["explained"] for k in range(r)], share, rtol=1e-9)
    row = got[ids[0]][1]
    assert row["n"] == n and row["identity_error"] < 1e-9


def test_given_table_equals_eigenvectors(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    check(op11_whitened_components(spark, folder), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_awkward_rows_are_left_out(spark):
    rng = np.random.default_rng(3)
    good = rng.standard_normal((40, 6)).astype(np.float32)
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    rows = [(i, v.tolist(), None) for i, v in enumerate(good)] + [(100 + i, v, 1) for i, v in enumerate(bad)]
    df = table(spark, rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in [*CLASHING, "x", "v", "component"]})
    check(whitening.whitened(df), list(range(40)), good)


def test_fewer_components_and_null_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((30, 5)).astype(np.float32)
    rows = [(7 if i < 10 else None, a.tolist(), 0) for i, a in enumerate(v)]
    out = whitening.whitened(table(spark, rows, SCHEMA), components=2)
    assert out.count() == 60
    assert out.where("vec_id is null").count() == 40
    assert out.select("identity_error").first()[0] < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(i, [0.5, 0.25], 0) for i in range(5)], [(1, None, 0)]])
def test_no_variance_no_rows(spark, rows):
    out = whitening.whitened(table(spark, rows, SCHEMA))
    assert out.collect() == []
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_constant_dimensions_are_no_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [*a.tolist(), 1.0, 1.0], 0) for i, a in enumerate(rng.standard_normal((20, 3)))]
    assert whitening.whitened(table(spark, rows, SCHEMA)).agg(F.max("component")).first()[0] == 3


def test_very_large_entries_stay_exact(spark):
    v = [[1e12, 3.0], [-2e12, 5.0], [5e11, -1.0]]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(table(spark, list(zip(range(3), v, [0] * 3)), "vec_id bigint, embedding array<double>, label int")).collect()}
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in row] for row in v]
    sums = [sum(c) for c in zip(*x)]
    assert got == {i: sum((3 * c - s) ** 2 for c, s in zip(row, sums)) for i, row in enumerate(x)}


def test_limbs_equal_python_numbers():
    rng = np.random.default_rng(6)
    whole = rng.integers(-(1 << 59), 1 << 59, (20, 50))
    assert [int(v.as_py()) for v in whitening._squares(whole)] == [sum(int(c) ** 2 for c in row) for row in whole]


@pytest.mark.parametrize("spread", [[5.0] * 6, [5.0, 5.0, 4.0, 4.0, 4.0, 1.0], [9.0, 0.0, 0.0, 0.0, 0.0, 0.0], [1e4, 1.0, 1e-2, 1e-3, 1e-3, 0.0]])
def test_equal_and_tiny_values_are_all_found(spread):
    turn = np.linalg.qr(np.random.default_rng(7).standard_normal((6, 6)))[0]
    x = np.vstack([np.diag(spread), -np.diag(spread)]) @ turn

    def product(z):
        u = x @ z
        return x.T @ u, float(u @ u)

    values, axes = whitening.leading_components(product, 6, 4)
    true = np.linalg.svd(x, compute_uv=False)[:4]
    true = true[true > 1e-9 * true[0]]
    assert np.allclose(values[: len(true)], true, rtol=1e-10)
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-12)
    assert np.allclose(x.T @ (x @ axes), axes * values**2, atol=1e-10 * values[0] ** 2)
