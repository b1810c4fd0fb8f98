"""Least squares from one aggregate row of centred sums."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.functions.coerce import ref


@dataclass(frozen=True)
class LinearFit:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    rows: int

    def predict(self) -> Column:
        expr = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            expr = expr + ref(name) * F.lit(weight)
        return expr


def centres(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The mean of each column over all rows, 0 without values; one aggregate row.

    Sums of products are taken around them, so that little cancels. Plain sums compile to tight code, which
    the built-in covariance aggregates, many at a time, do not.
    """
    row = df.agg(*[F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(columns)]).head()
    return {c: row[i] or 0.0 for i, c in enumerate(columns)}


def fit(
    df: DataFrame, features: Sequence[str], target: str, centre: dict[str, float] | None = None
) -> LinearFit:
    """Ordinary least squares on rows without NULLs.

    One scan gives the (p+1)² sums of products, whatever the number of rows; only that small matrix is solved on the
    driver. Dependent features get the solution of least norm. ``centre`` gives the means, to save a scan.
    """
    names = [*features, target]
    centre = centre or centres(df, names)
    slim = df.select(*[(ref(c) - F.lit(centre[c])).alias(f"x{i}") for i, c in enumerate(names)])
    parts: list[Column] = [F.count(F.lit(1)).alias("n")]
    parts += [F.sum(f"x{i}").alias(f"s_{i}") for i in range(len(names))]
    parts += [(F.min(f"x{i}") < F.max(f"x{i}")).alias(f"v_{i}") for i in range(len(names))]
    for i in range(len(names)):
        for j in range(i, len(names)):
            parts.append(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p_{i}_{j}"))
    row = slim.agg(*parts).head()
    n, p = row["n"], len(features)
    if not n:
        raise ValueError("No complete rows to fit.")
    means = np.array([row[f"s_{i}"] / n for i in range(p + 1)])
    products = np.array([[row[f"p_{min(i, j)}_{max(i, j)}"] / n for j in range(p + 1)] for i in range(p + 1)])
    moments = products - np.outer(means, means)
    # A constant column has no spread, whatever rounding left of it.
    varies = np.array([bool(row[f"v_{i}"]) for i in range(p + 1)])
    spread = np.where(varies, np.maximum(np.diag(moments), 0.0), 0.0)
    # Scale to unit variance first: features may differ by many orders of magnitude.
    scale = np.sqrt(spread[:p])
    usable = scale > 0
    scale[~usable] = 1.0
    gram = moments[:p, :p] / np.outer(scale, scale) * np.outer(usable, usable)
    cross = moments[:p, p] / scale * usable
    solved = np.linalg.lstsq(gram, cross, rcond=1e-12)[0] / scale
    means = means + np.array([centre[c] for c in names])
    intercept = means[p] - float(np.dot(solved, means[:p]))
    return LinearFit(tuple(features), tuple(float(w) for w in solved), float(intercept), n)


def metrics(scored: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """One row: R², RMSE and the number of scored rows."""
    error = F.pow(ref(target) - F.col(prediction), 2)
    total = F.var_pop(ref(target)) * F.count(F.lit(1))
    return scored.agg(
        F.when(total == 0, F.when(F.sum(error) == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide(F.sum(error), total))
        .alias("r2"),
        F.sqrt(F.avg(error)).alias("rmse"),
        F.count(F.lit(1)).alias("test_points"),
    )
