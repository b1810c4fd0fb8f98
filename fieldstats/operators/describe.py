"""Descriptive statistics per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.functions.coerce import number, numeric_columns
from fieldstats.model import Result, Roles
from fieldstats.plans import quantiles

_QUARTILES = (0.25, 0.5, 0.75)
_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, "
    "`25%` double, `50%` double, `75%` double, max double"
)


def choose_features(
    df: DataFrame, features: Sequence[str] | None, roles: Roles | None, at_least: int = 1, exclude: str | None = None
) -> list[str]:
    """Asked-for columns, else the variables, else every numeric column; only numeric ones are kept."""
    numeric = numeric_columns(df)
    wanted = list(features or ()) or list(roles.variables if roles else ()) or numeric
    chosen = [c for c in wanted if c in numeric and c != exclude]
    if len(chosen) < at_least:
        raise ValueError(f"At least {at_least} numeric column(s) are needed, found {len(chosen)}.")
    return chosen


def describe_table(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles, max per column, as one row each.

    One scan for the moments and a sketch, one for the exact quartiles; each returns a few rows. ``exact=False`` takes approximate
    quartiles from the first scan instead.
    """
    slim = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = slim.columns
    parts = [F.avg(c).alias(f"mean_{i}") for i, c in enumerate(names)]
    parts += [F.stddev_samp(c).alias(f"std_{i}") for i, c in enumerate(names)]
    if not exact:
        parts += [
            F.percentile_approx(c, list(_QUARTILES), quantiles.ACCURACY).alias(f"near_{i}")
            for i, c in enumerate(names)
        ]
    first = quantiles.first_scan(slim, names, _QUARTILES, parts)
    if exact:
        quartiles = quantiles.finish(slim, names, _QUARTILES, first)
    else:
        quartiles = {c: first[f"near_{i}"] or [None] * 3 for i, c in enumerate(names)}
    rows = [
        (
            column,
            first[f"n_{i}"],
            first[f"mean_{i}"],
            first[f"std_{i}"],
            first[f"low_{i}"],
            *quartiles[names[i]],
            first[f"high_{i}"],
        )
        for i, column in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, _SCHEMA)


def descriptive_stats(
    df: DataFrame, features: Sequence[str] | None = None, roles: Roles | None = None, exact: bool = True
) -> Result:
    columns = choose_features(df, features, roles)

    def summary() -> DataFrame:
        table = describe_table(df, columns, exact)
        return table.select(
            "column", "count", *[F.round(f"`{c}`", 6).alias(c) for c in table.columns if c not in ("column", "count")]
        )

    return Result("descriptive_stats", records={"summary": summary}, info={"columns": columns})
