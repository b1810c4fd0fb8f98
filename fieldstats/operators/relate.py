"""Pairwise correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.functions.coerce import number
from fieldstats.model import Result, Roles
from fieldstats.operators.describe import choose_features
from fieldstats.plans.pairs import correlations


def correlation_pairs(df: DataFrame, columns: Sequence[str], digits: int | None = 6) -> DataFrame:
    """Every ordered pair as ``(col_a, col_b, r)``. Rows missing a value are left out of the pairs that need it; a pair with a constant
    side, or without rows, has a NULL. A scan for the means and one for all pairs."""
    found = correlations(df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)]))
    rows = [
        (a, b, found.get((min(i, j), max(i, j)))) for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    long = df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")
    return long.withColumn("r", F.round("r", digits)) if digits is not None else long


def correlation_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column, one cell per other column. ``pairs`` has one row per pair, so it is small."""
    cells = [F.max(F.when(F.col("col_b") == c, F.col("r"))).alias(c) for c in columns]
    return pairs.groupBy(F.col("col_a").alias("column")).agg(*cells)


def correlation(df: DataFrame, features: Sequence[str] | None = None, roles: Roles | None = None) -> Result:
    columns = choose_features(df, features, roles, at_least=2)
    result = Result("correlation", info={"columns": columns})
    result.add("pairs", lambda: correlation_pairs(df, columns))
    result.add("matrix", lambda: correlation_matrix(result["pairs"], columns))
    return result
