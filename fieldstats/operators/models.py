"""Regression of one column on others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.coerce import number
from fieldstats.model import Result, Roles
from fieldstats.operators.describe import choose_features
from fieldstats.plans import forest, gram


def complete_rows(
    df: DataFrame, features: Sequence[str], target: str, held_out: Column | None, split_key: Sequence[str]
) -> DataFrame:
    """Features and target without NULLs, and ``__test``: whether the row is held out (a fifth of the rows).

    The choice is a hash of the row's key, or of its values, so a row keeps its side however the data are laid out,
    and copies of a row are never on both sides.
    """
    names = [*features, target]
    key = [F.col(f"`{c}`") for c in (split_key or names)]
    test = held_out if held_out is not None else F.pmod(F.xxhash64(*key), F.lit(5)) == 0
    slim = df.select(*[number(df, c).alias(c) for c in names], test.alias("__test"))
    return slim.dropna(subset=[f"`{c}`" if "." in c else c for c in names])


def _features(df: DataFrame, target: str | None, features: Sequence[str] | None, roles: Roles | None):
    roles = roles or Roles()
    target = target or roles.target
    if not target:
        raise ValueError("A numeric target column is needed. Name one or set the variable roles.")
    if not features:
        features = [v for v in roles.variables if v != target]
        if not features:
            raise ValueError("At least one numeric feature column is needed.")
    return target, choose_features(df, features, None, 1, exclude=target)


def _enough(rows: DataFrame, at_least: int) -> None:
    """Counts no further than it has to."""
    found = len(rows.take(at_least))
    if found < at_least:
        raise ValueError(f"At least {at_least} complete rows are needed, found {found}.")


def linear_regression(
    df: DataFrame,
    target: str | None = None,
    features: Sequence[str] | None = None,
    roles: Roles | None = None,
    held_out: Column | None = None,
    split_key: Sequence[str] = (),
) -> Result:
    """Least squares on four fifths of the rows, scored on the rest: one scan to fit, one to score."""
    target, features = _features(df, target, features, roles)
    rows = complete_rows(df, features, target, held_out, split_key)
    _enough(rows, fixed.MIN_REGRESSION_ROWS)
    line = gram.fit(rows.where(~F.col("__test")), features, target)
    scored = rows.where("__test").withColumn("prediction", line.predict())
    spark = df.sparkSession

    def scores() -> DataFrame:
        return gram.metrics(scored, target).select(F.lit(line.intercept).alias("intercept"), "*")

    weights = [(f, w) for f, w in zip(line.features, line.coefficients)]
    return Result(
        "linear_regression",
        facts={"coverage": scores},
        records={
            "coefficients": lambda: spark.createDataFrame(weights, "feature string, coefficient double"),
            "predictions": scored.drop("__test"),
        },
        info={"target_column": target, "feature_columns": features},
    )


def random_forest_regression(
    df: DataFrame,
    target: str | None = None,
    features: Sequence[str] | None = None,
    roles: Roles | None = None,
    n_estimators: int = fixed.FOREST_TREES,
    max_depth: int | None = None,
    bag_rows: int = 16_384,
    max_bins: int = 256,
    held_out: Column | None = None,
    split_key: Sequence[str] = (),
) -> Result:
    """Averaged regression trees that may use every feature at each split and, without ``max_depth``, end in pure leaves. Every tree is grown
    in one task, from about ``bag_rows`` rows at most; see ``plans.forest``."""
    target, features = _features(df, target, features, roles)
    rows = complete_rows(df, features, target, held_out, split_key)
    _enough(rows, fixed.MIN_FOREST_ROWS)
    grown = forest.fit(rows.where(~F.col("__test")), features, target, int(n_estimators), bag_rows, max_bins, max_depth)
    scored = grown.predict(rows.where("__test"))
    weights = list(zip(features, grown.importances()))
    return Result(
        "random_forest_regression",
        facts={"coverage": lambda: gram.metrics(scored, target)},
        records={
            "feature_importance": lambda: df.sparkSession.createDataFrame(
                weights, "feature string, importance double"
            ),
            "predictions": scored,
        },
        info={"target_column": target, "feature_columns": features},
    )
