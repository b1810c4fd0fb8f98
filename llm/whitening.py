"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ref, saved

_WHOLE = pa.decimal128(38, 0)
_LIMB = 21


@dataclass(frozen=True)
class Whitening:
    """What turns a row into components: ``axes`` has a unit column for each, ``spread`` their variances."""

    n: int
    sums: list[int]
    axes: np.ndarray
    spread: np.ndarray
    total: float


def _times_n(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: 64-bit integers where they suffice, else Python's."""
    peak = max(int(np.abs(x).max(initial=0)), 1)
    if 2 * n * peak < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_times_n(x, n, sums) / n).astype(np.float64)


def _decimals(values: Iterator[int]) -> pa.Array:
    """Whole numbers of up to 38 digits; null beyond."""
    return pa.array([Decimal(v) if v < 10**38 else None for v in values], _WHOLE)


def _squares(whole: np.ndarray) -> pa.Array:
    """Exact sums of squares by row. Beyond 64 bits they are put together from limbs of 21 bits, one Python number a row."""
    if whole.dtype == object:
        return _decimals(int(v) for v in (whole * whole).sum(axis=1))
    size = np.abs(whole)
    peak = int(size.max(initial=0))
    if peak * peak * whole.shape[1] < 1 << 62:
        return pa.array((whole * whole).sum(axis=1)).cast(_WHOLE)
    limbs = [size >> (_LIMB * k) & ((1 << _LIMB) - 1) for k in range(3)]
    parts = [
        (limbs[a] * limbs[b]).sum(axis=1) * (1 if a == b else 2) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    ]
    shifts = (0, 1, 2, 2, 3, 4)
    return _decimals(sum(int(p[i]) << (_LIMB * s) for p, s in zip(parts, shifts, strict=True)) for i in range(len(whole)))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``part`` of all rows, added up: a partial sum in each task, then a sum by place. Only the totals come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                now = part(_matrix(batch, d))
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    sums = rows.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r["place"] for r in sums), default=-1) + 1)
    for r in sums:
        out[r["place"]] = r["value"]
    return out


def _column_sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, dtype=object)
        for batch in batches:
            x = _matrix(batch, d)
            wide = int(np.abs(x).max(initial=0)) * max(len(x), 1) >= 1 << 62
            total = total + (x.astype(object) if wide else x).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d, dtype=np.int32)), pa.array([Decimal(int(v)) for v in total], _WHOLE)], ["place", "value"]
        )

    sums = rows.select("x").mapInArrow(run, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()
    return [int(r["value"]) for r in sorted(sums, key=lambda r: r["place"])]


def bidiagonal_components(
    product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, want: int, locked: np.ndarray, seed: int, tolerance: float
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Leading singular values and right vectors of X outside the span of ``locked``, and whether that complement is used up.

    ``product(z)`` gives Xᵀ(Xz) and |Xz|² for a vector z of length d, from one pass over the rows. The recurrence

        alpha u_k = X v_k - beta u_(k-1)        beta v_(k+1) = Xᵀ u_k - alpha v_k

    turns X into the upper bidiagonal B with alphas on and betas above the diagonal. Both families are fully reorthogonalised: the short
    v by themselves, twice; the long u through the images that define them. A left vector is never stored: u_k = X w_k with
    w_k of length d, so that uⱼ · Xz = wⱼ · XᵀXz and Xᵀ uⱼ are at hand without another pass. Of B = P S Qᵀ, V Q holds the
    right vectors; the residual of one is beta times the last entry of its column of P. Steps end when the first ``want`` residuals are
    below ``tolerance`` times the largest value, or when nothing is left to find.
    """
    draw = np.random.default_rng(seed).standard_normal(d)

    def outside(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            v = v - locked @ (locked.T @ v)
            if basis:
                b = np.array(basis)
                v = v - b.T @ (b @ v)
        return v

    begin, _ = product(outside(draw, []))
    scale = np.linalg.norm(begin)
    v = outside(begin, [])
    if not scale or np.linalg.norm(v) <= 1e-12 * scale:
        return np.zeros(0), np.zeros((d, 0)), True
    v = v / np.linalg.norm(v)
    right, images, backs, alphas, betas = [v], [], [], [], []
    z = v
    while True:
        y, length = product(z)
        if images:
            w, g = np.array(images), np.array(backs)
            h = w @ y
            z, y, length = z - w.T @ h, y - g.T @ h, length - h @ h
        alpha = np.sqrt(max(length, 0.0))
        top = max(alphas, default=alpha)
        if not alpha or alpha <= 1e-13 * top:
            right.pop()
            spent = True
            break
        images.append(z / alpha)
        backs.append(y / alpha)
        alphas.append(alpha)
        r = outside(backs[-1] - alpha * right[-1], right)
        beta = np.linalg.norm(r)
        left, values, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        spent = len(right) + locked.shape[1] >= d or beta <= 1e-14 * values[0]
        if spent or (len(values) >= want and np.all(beta * np.abs(left[-1, :want]) <= tolerance * values[0])):
            break
        betas.append(beta)
        right.append(r / beta)
        z = right[-1] - beta * images[-1]
    if not alphas:
        return np.zeros(0), np.zeros((d, 0)), True
    k = len(alphas)
    _, values, q = np.linalg.svd(np.diag(alphas) + np.diag(betas[: k - 1], 1))
    return values[:want], (np.array(right[:k]).T @ q.T)[:, :want], spent and k + locked.shape[1] >= d


def leading_components(product, d: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest singular values of X with their right vectors, equal values as often as they occur.

    One start vector sees one direction of each value. So further runs look in the complement of what was found, until the largest
    value there is not above the smallest one kept.
    """
    values, axes, done = bidiagonal_components(product, d, want, np.zeros((d, 0)), 1, 1e-15)
    seed = 1
    while len(values) and not done:
        seed += 1
        full = len(values) >= want
        more, found, done = bidiagonal_components(product, d, max(want - len(values), 1), axes, seed, 1e-9 if full else 1e-15)
        if not len(more) or (full and more[0] <= values[-1]):
            break
        if full:
            more, found, done = *bidiagonal_components(product, d, 1, axes, seed, 1e-15)[:2], False
        values, axes = np.append(values, more), np.column_stack([axes, found])
        order = np.argsort(-values, kind="stable")[:want]
        values, axes = values[order], axes[:, order]
    return values, axes


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Saved rows ``id``, ``x`` (whole numbers floor(64 c) + 1000000) and the number of dimensions; the rules of ``whitened``."""
    v = F.transform(ref(vector_col), lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 55)))
    good = vectors.select(ref(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    x = F.transform("v", lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("long"))
    return saved(good.where(F.size("v") == d).select("id", x.alias("x"))), d


def fit(rows: DataFrame, d: int, components: int = 32, least: float = 1e-9) -> Whitening:
    """Components of all ``rows``. Each step of the bidiagonalisation is one pass: the driver holds vectors of length d only."""
    n = rows.count()
    sums = _column_sums(rows, d) if n else []
    if not n:
        return Whitening(0, [], np.zeros((d, 0)), np.zeros(0), 0.0)

    def squared(x: np.ndarray) -> np.ndarray:
        c = _centred(x, n, sums)
        return np.array([np.sum(c * c)])

    total = float(_summed(rows, d, squared)[0])

    def product(z: np.ndarray) -> tuple[np.ndarray, float]:
        def both(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            u = c @ z
            return np.append(c.T @ u, u @ u)

        found = _summed(rows, d, both)
        return found[:-1], float(found[-1])

    values, axes = leading_components(product, d, min(components, d)) if total else (np.zeros(0), np.zeros((d, 0)))
    keep = values > least * values[0] if len(values) else np.zeros(0, bool)
    return Whitening(n, sums, axes[:, keep], values[keep] ** 2 / n, total / n)


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows; 0 without components."""
    r = model.axes.shape[1]
    if not r:
        return 0.0
    turn = model.axes / np.sqrt(model.spread)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, model.n, model.sums) @ turn
        return np.append(w.sum(axis=0), (w.T @ w).ravel())

    found = _summed(rows, d, moments) / model.n
    mean = found[:r]
    return float(np.abs(found[r:].reshape(r, r) - np.outer(mean, mean) - np.eye(r)).max())


def whitened(
    vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 1e-9
) -> DataFrame:
    """A row per usable row of ``vectors`` and component: the id, ``component`` (from 1, by falling variance), ``n`` (usable rows), ``deviation``
    (exact sum over dimensions of (n x - S)², decimal(38,0), null beyond 38 digits), ``whitened``, ``explained`` (share of the whole variance) and ``identity_error``.

    Entries c become x = floor(64 c) + 1000000, as whole numbers; S are their sums. ``whitened`` is x - S/n, centred in whole numbers and
    unrounded, projected on the unit component and divided by the root of its variance (divisor n).

    Left out are rows whose vector is null, empty, or holds a null, a NaN, an infinity or an entry of 2^55 or more (its x has no
    long), and rows whose vector is not as long as most (of equally common lengths the longer counts). Ids play no part: null and repeated
    ids, and equal vectors, each keep their rows. Components with a deviation of at most ``least`` times the largest cannot be
    scaled to one and are left out; so equal vectors, a single one and an empty table give no rows. Equal variances: any
    orthonormal choice, the same for all rows. Other columns are not looked at.
    """
    rows, d = usable(vectors, id_col, vector_col)
    model = fit(rows, d, components, least)
    r = model.axes.shape[1]
    turn = model.axes / np.sqrt(model.spread) if r else model.axes
    error = identity_error(rows, d, model)
    share = model.spread / model.total if model.total else model.spread
    n, sums = model.n, model.sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not r:
                continue
            whole = _times_n(_matrix(batch, d), n, sums)
            w = (whole / n).astype(np.float64) @ turn
            m = len(w)
            at = pa.array(np.repeat(np.arange(m), r))
            columns = [
                batch["id"].take(at),
                pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), m)),
                pa.array(np.full(m * r, n, dtype=np.int64)),
                _squares(whole).take(at),
                pa.array(w.ravel()),
                pa.array(np.tile(share, m)),
                pa.array(np.full(m * r, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    named: list[Column] = [F.col("id").alias(id_col), *[F.col(c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]]
    return rows.mapInArrow(project, shape).select(*named)
