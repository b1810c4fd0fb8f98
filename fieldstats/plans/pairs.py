"""Pearson correlation of all pairs of columns from masked matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.plans.gram import centres

#: A spread below this share of the sum of squares around the rough mean is mostly rounding, and is taken again around the pair's own mean.
_LOST = 1e-9
_SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def _cells(batch: pa.RecordBatch, columns: list[int], centre: np.ndarray) -> np.ndarray:
    """Rows by columns, centred; missing cells are NaN."""
    return np.stack([batch[c].to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.float64) - centre


def pair_sums(slim: DataFrame, centre: np.ndarray) -> DataFrame:
    """For every pair ``i`` <= ``j`` of the columns of ``slim``: the rows ``n`` that have both, and their sums around ``centre``.

    With X the cells (0 where missing) and M what is there, all pairs' sums are the products MᵀM, XᵀM, (X²)ᵀM and XᵀX. A task adds them
    up over its batches and sends them once; Spark adds the tasks up by pair. One scan, however many columns and gaps. A task
    holds four numbers a pair.
    """
    size = len(slim.columns)
    upper = np.triu_indices(size)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, size, size))
        for batch in batches:
            x = _cells(batch, list(range(size)), centre)
            there = ~np.isnan(x)
            x[~there] = 0.0
            m = there.astype(np.float64)
            total += (m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x)
        n, s, q, p = total
        parts = [n[upper], s[upper], s.T[upper], q[upper], q.T[upper], p[upper]]
        some = np.flatnonzero(parts[0])
        numbers = [pa.array(u[some].astype(np.int32)) for u in upper] + [pa.array(v[some]) for v in parts]
        yield pa.RecordBatch.from_arrays(numbers, ["i", "j", *_SUMS])

    shape = "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS)
    return slim.mapInArrow(products, shape).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _again(slim: DataFrame, centre: np.ndarray, pairs: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple[bool, np.ndarray]]:
    """Sums around each pair's own means, and whether both sides vary at all, for the given pairs. One scan."""
    keys = np.array(sorted(pairs), dtype=np.int32)
    means = np.array([pairs[tuple(k)] for k in keys.tolist()])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, low, high = np.zeros((len(keys), 6)), np.full((len(keys), 2), np.inf), np.full((len(keys), 2), -np.inf)
        for batch in batches:
            cells = _cells(batch, list(range(len(centre))), centre)
            for k, (i, j) in enumerate(keys):
                both = cells[:, [i, j]]
                both = both[~np.isnan(both).any(axis=1)]
                if len(both):
                    low[k], high[k] = np.minimum(low[k], both.min(axis=0)), np.maximum(high[k], both.max(axis=0))
                    x, y = (both - means[k]).T
                    sums[k] += (len(both), x.sum(), y.sum(), x @ x, y @ y, x @ y)
        some = np.flatnonzero(sums[:, 0])
        numbers = [pa.array(keys[some, 0]), pa.array(keys[some, 1]), *[pa.array(sums[some, c]) for c in range(6)]]
        numbers += [pa.array(v[some, side]) for v in (low, high) for side in (0, 1)]
        yield pa.RecordBatch.from_arrays(numbers, ["i", "j", *_SUMS, "lx", "ly", "hx", "hy"])

    shape = "i int, j int, " + ", ".join(f"{c} double" for c in [*_SUMS, "lx", "ly", "hx", "hy"])
    added = slim.mapInArrow(moments, shape).groupBy("i", "j")
    varies = (F.min("lx") < F.max("hx")) & (F.min("ly") < F.max("hy"))
    rows = added.agg(*[F.sum(c).alias(c) for c in _SUMS], varies.alias("varies")).collect()
    return {(r["i"], r["j"]): (r["varies"], np.array([r[c] for c in _SUMS])) for r in rows}


def _spread(sums: np.ndarray) -> tuple[float, float]:
    n, x, y, xx, yy, _ = sums
    return xx - x * x / n, yy - y * y / n


def _pearson(sums: np.ndarray) -> float | None:
    n, x, y, _, _, xy = sums
    a, b = _spread(sums)
    if a <= 0 or b <= 0:
        return None
    r = (xy - x * y / n) / (np.sqrt(a) * np.sqrt(b))
    return float(max(-1.0, min(1.0, r)))


def correlations(slim: DataFrame) -> dict[tuple[int, int], float | None]:
    """The correlation of every pair ``i`` <= ``j`` of columns, over the rows that have both values; None where there is no such row or a
    side is constant. Two scans: the means, and all products. A third only if some pair's values lie so close together, or so far from the
    mean, that a spread is lost in rounding."""
    found = centres(slim, slim.columns)
    centre = np.array([found[c] for c in slim.columns])
    sums = {(r["i"], r["j"]): np.array([r[c] for c in _SUMS]) for r in pair_sums(slim, centre).collect()}
    doubtful = {}
    for pair, s in sums.items():
        a, b = _spread(s)
        if s[0] > 1 and (a <= _LOST * s[3] or b <= _LOST * s[4]):
            doubtful[pair] = s[1:3] / s[0]
    out = {pair: None if s[0] < 2 or pair in doubtful else _pearson(s) for pair, s in sums.items()}
    if doubtful:
        out |= {pair: _pearson(s) if varies else None for pair, (varies, s) in _again(slim, centre, doubtful).items()}
    return {(i, j): 1.0 if i == j and r is not None else r for (i, j), r in out.items()}
