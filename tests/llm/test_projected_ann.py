import math

import numpy as np
import pytest

from llm.projected_ann import Cells, Space, box_distances, chi_square_quantile, lay_out, nearest
from tests.llm.helpers import CLASHING, table

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, asked, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = sorted({len(v) for _, v in good}, key=lambda n: (-sum(len(v) == n for _, v in good), n))
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in good if len(v) == sizes[0]]
    queries = {}
    for i, v in good:
        if i in asked:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scores = []
        for i, w in good:
            if i != q:
                total = 0.0
                for a, b in zip(w, v, strict=True):
                    total += a * b
                scores.append((-total, i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


AWKWARD = [
    (0, [1.0, 0.0, 0.0]), (1, [0.5, 0.5, 0.0]), (2, [0.5, 0.5, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]),
    (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]), (8, [1.0, 2.0]), (9, []), (None, [1.0, 1.0, 1.0]), (10, [3.0, -1.0, 2.0]),
    (10, [3.0, -1.0, 2.0]), (20, [-1.0, -1.0, 0.25]), (40, [0.0, 0.0, 5.0]), (20, [-1.0, -1.0, 0.25]),
]


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, clashing):
    vectors = table(spark, AWKWARD, SCHEMA)
    if clashing:
        vectors = vectors.selectExpr("*", *[f"'x' AS `{c}`" for c in [*CLASHING, "vector", "block", "asks", "rank"]])
    asked = {i for i, _ in AWKWARD if i is not None and i % 20 == 0}
    for k in (2, 20):
        got = nearest(vectors, vectors.where("vec_id % 20 = 0"), k=k, sure=1 - 1e-9)
        assert sorted(map(tuple, got.collect())) == plain(AWKWARD, asked, k)


def test_empty_tables(spark):
    some, none = table(spark, AWKWARD, SCHEMA), table(spark, [], SCHEMA)
    assert nearest(none, some).count() == nearest(some, none).count() == nearest(table(spark, [(1, [0.0])], SCHEMA), some).count() == 0


@pytest.mark.parametrize("kind", ["directions", "lengths", "groups"])
def test_recall_against_brute_force(spark, kind):
    draw = np.random.default_rng(8)
    vectors = draw.standard_normal((3000, 32))
    if kind == "groups":
        vectors = draw.standard_normal((30, 32))[draw.integers(0, 30, 3000)] + 0.2 * vectors
    if kind != "lengths":
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors.astype(np.float32).astype(float)
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), block_rows=700).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert len(got) == 150 and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & set(found))
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in found.items())
    assert hits / (20 * len(got)) >= 0.9


def test_chi_square_quantile():
    assert chi_square_quantile(0.95, 2) == pytest.approx(5.991465, abs=1e-5)
    assert chi_square_quantile(0.95, 16) == pytest.approx(26.296228, abs=1e-5)


def grouped(n, groups, d, seed=9):
    draw = np.random.default_rng(seed)
    v = draw.standard_normal((groups, d))[draw.integers(0, groups, n)] + 0.15 * draw.standard_normal((n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float)


def test_recall_and_pruning_over_many_cells(spark):
    """20,000 vectors in cells of 500: recall by brute force, and most blocks are never asked where vectors lie in groups."""
    vectors = grouped(20_000, 200, 48)
    path_rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = table(spark, path_rows, SCHEMA).repartition(4).cache()
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), block_rows=500).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.arange(0, 20_000, 20)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    assert np.mean([len(got[q] & set(b.tolist())) / 20 for q, b in zip(asked.tolist(), best, strict=True)]) >= 0.97
    space = Space(48, 1.0000001, 16, 0.97, 11)
    layout = lay_out(df.selectExpr("vec_id as id", "cast(embedding as array<double>) as vector"), space, 20_000, 500, 1 << 17)
    assert 40 <= len(layout.blocks) <= 80 and layout.blocks.sum() < 100
    kth = np.sort(scores, axis=1)[:, -20]
    reach = box_distances(space.queries(vectors[asked]), layout.low, layout.high)
    admitted = np.mean([space.admits(c, kth, vectors[asked]) for c in reach.T])
    assert admitted < 0.4


def test_a_third_of_the_vectors_equal(spark):
    vectors = grouped(900, 20, 12, 3)
    vectors[::3] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = table(spark, rows, SCHEMA)
    got = nearest(df, df.where("vec_id % 20 = 0"), k=10, sure=1 - 1e-9, block_rows=50)
    assert sorted(map(tuple, got.collect())) == plain(rows, {i for i in range(0, 900, 20)}, 10)


def test_cells_cover_any_point():
    draw = np.random.default_rng(1)
    sample = draw.standard_normal((1000, 4))
    cells = Cells.fit(sample, 20)
    assert sorted(set(cells.of(sample))) == list(range(20)) and np.bincount(cells.of(sample)).min() >= 16
    assert set(cells.of(100 * draw.standard_normal((500, 4)))) <= set(range(20))
    assert list(Cells.fit(np.ones((500, 4)), 20).of(sample)) == [0] * 1000
