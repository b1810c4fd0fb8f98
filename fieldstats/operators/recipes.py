"""Derived columns: unit conversions, constant arithmetic, rolling and calendar means."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.coerce import field_type, number, ref, require_times, timestamp
from fieldstats.model import Roles
from fieldstats.plans.halo import rolling_mean
from fieldstats.plans.rowindex import with_row_index
from fieldstats.session import use_utc

_UNITS: dict[str, Callable[[Column], Column]] = {
    "kelvin_to_celsius": lambda x: x - fixed.KELVIN_OFFSET,
    "kelvin_to_fahrenheit": lambda x: (x - fixed.KELVIN_OFFSET) * 9.0 / 5.0 + 32.0,
    "celsius_to_kelvin": lambda x: x + fixed.KELVIN_OFFSET,
    "ms_to_kmh": lambda x: x * fixed.KMH_PER_MS,
    "ms_to_mph": lambda x: x * fixed.MPH_PER_MS,
    "pa_to_hpa": lambda x: x / fixed.PA_PER_HPA,
}
_ARITHMETIC: dict[str, Callable[[Column, float], Column]] = {
    "multiply_constant": lambda x, c: x * F.lit(c),
    "divide_constant": lambda x, c: F.try_divide(x, F.lit(c)),
    "add_constant": lambda x, c: x + F.lit(c),
    "subtract_constant": lambda x, c: x - F.lit(c),
}
_CALENDAR = {"aggregate_by_day": "D", "aggregate_by_month": "ME"}


@dataclass(frozen=True)
class Recipe:
    source: str
    operation: str
    output: str
    parameters: dict[str, object] = field(default_factory=dict)
    recipe_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


def make_recipe(
    source: str,
    operation: str,
    output: str | None = None,
    roles: Roles | None = None,
    **parameters: object,
) -> Recipe:
    """A checked recipe that keeps only the parameters its operation reads."""
    source = str(source).strip()
    output = suggested_name(source, operation) if output is None else str(output).strip()
    if not source or not output:
        raise ValueError("A recipe needs a source and an output name.")
    if source == output:
        raise ValueError("The output name must differ from the source.")
    if operation in _UNITS:
        kept: dict[str, object] = {k: v for k, v in parameters.items()}
    elif operation in _ARITHMETIC:
        kept = {"constant": _constant(parameters.get("constant"), operation)}
    elif operation == "rolling_mean" or operation in _CALENDAR:
        time = str(parameters.get("time_column") or (roles.time if roles else None) or "").strip()
        if not time:
            raise ValueError(f"{operation} needs a time column.")
        kept = {"time_column": time}
        if operation == "rolling_mean":
            window = int(parameters.get("window", fixed.ROLLING_WINDOW))
            if window < 1:
                raise ValueError("The rolling window must hold at least one row.")
            kept["window"] = window
            if parameters.get("order_by"):
                kept["order_by"] = tuple(parameters["order_by"])
    else:
        raise ValueError(f"Unknown operation '{operation}'. Known: {', '.join(fixed.RECIPE_SUFFIXES)}")
    return Recipe(source, operation, output, kept)


def _constant(value: object, operation: str) -> float:
    try:
        parsed = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise ValueError(f"{operation} needs a numeric constant.") from None
    if operation == "divide_constant" and parsed == 0:
        raise ValueError("The divisor must not be zero.")
    return parsed


def suggested_name(source: str, operation: str) -> str:
    return f"{source}_{fixed.RECIPE_SUFFIXES.get(operation, 'derived')}"


def apply_recipe(df: DataFrame, recipe: Recipe, roles: Roles | None = None) -> DataFrame:
    """Adds the recipe's column. Rolling means number the rows first and so run a job; the others stay lazy."""
    use_utc(df.sparkSession)
    field_type(df, recipe.source)
    value = number(df, recipe.source)
    if recipe.operation in _UNITS:
        return df.withColumn(recipe.output, _UNITS[recipe.operation](value))
    if recipe.operation in _ARITHMETIC:
        return df.withColumn(recipe.output, _ARITHMETIC[recipe.operation](value, recipe.parameters["constant"]))
    time = recipe.parameters.get("time_column") or (roles.time if roles else None)
    if not time:
        raise ValueError(f"{recipe.operation} needs a time column.")
    if recipe.operation == "rolling_mean":
        return rolling_column(
            df, recipe.source, time, recipe.parameters["window"], recipe.output, recipe.parameters.get("order_by", ())
        )
    if recipe.operation in _CALENDAR:
        return calendar_mean_column(df, recipe.source, time, recipe.operation, recipe.output)
    raise ValueError(f"Unknown operation '{recipe.operation}'.")


def apply_recipes(df: DataFrame, recipes: Sequence[Recipe], roles: Roles | None = None) -> DataFrame:
    """In order; a recipe may read what an earlier one made. Calendar means that follow each other share one aggregate."""
    waiting: list[Recipe] = []

    def time_of(recipe: Recipe) -> str | None:
        return recipe.parameters.get("time_column") or (roles.time if roles else None)

    def settle(table: DataFrame) -> DataFrame:
        if waiting:
            table = calendar_mean_columns(table, time_of(waiting[0]), [(r.source, r.operation, r.output) for r in waiting])
            waiting.clear()
        return table

    for recipe in recipes:
        together = recipe.operation in _CALENDAR and time_of(recipe)
        if waiting and not (together and time_of(recipe) == time_of(waiting[0])):
            df = settle(df)
        if together:
            waiting.append(recipe)
        else:
            df = apply_recipe(df, recipe, roles)
    return settle(df)


def rolling_column(
    df: DataFrame,
    source: str,
    time: str,
    window: int,
    output: str,
    order_by: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Mean of the last ``window`` rows in time order; rows without a time come last.

    Equal times follow ``order_by``, then the scan order. The order is global, so the rows are numbered and rolled in
    overlapping blocks (see ``plans.halo``).
    """
    require_times(df, time)
    staged = df.withColumn("__time", timestamp(df, time))
    order = [F.col("__time").asc_nulls_last(), *[ref(c) for c in order_by]]
    indexed = with_row_index(staged, order, "__row").drop("__time")
    return rolling_mean(indexed, number(df, source), window, output, "__row", block_rows).drop("__row")


def calendar_mean_column(df: DataFrame, source: str, time: str, operation: str, output: str) -> DataFrame:
    """Mean of the row's day or month, on every row."""
    return calendar_mean_columns(df, time, [(source, operation, output)])


def calendar_mean_columns(df: DataFrame, time: str, means: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Means of the row's day or month, on every row; ``means`` lists source, operation and output, and a source may be an
    earlier output.

    However many there are, the rows are read twice: once for sums and counts by day, once to get the results. Months, and
    means of means, are put together from the day table, which is calendar-bounded (at most 3.7 million days) and
    broadcast back, so the rows are not shuffled and a crowded day is not gathered anywhere. Rows without a time get NULL for
    days; for months they form a group of their own.
    """
    moment = timestamp(df, time)
    made = {output: f"__m{k}" for k, (_, _, output) in enumerate(means)}
    sources = list(dict.fromkeys(source for source, _, _ in means if source not in made))
    cells = df.select(F.to_date(moment).alias("__day"), *[number(df, c).alias(f"__v{i}") for i, c in enumerate(sources)])
    sums = [F.sum(f"__v{i}").alias(f"__s{i}") for i in range(len(sources))]
    counts = [F.count(f"__v{i}").alias(f"__c{i}") for i in range(len(sources))]
    days = cells.groupBy("__day").agg(F.count(F.lit(1)).alias("__n"), *sums, *counts)
    days = days.withColumn("__month", F.trunc("__day", "month"))
    for source, operation, output in means:
        if source in made:
            inner = F.col(made[source])
            total, count = inner * F.col("__n"), F.when(inner.isNotNull(), F.col("__n")).otherwise(0)
            daily = inner
        else:
            i = sources.index(source)
            total, count = F.col(f"__s{i}"), F.col(f"__c{i}")
            daily = F.try_divide(total, count)
        month = Window.partitionBy("__month")
        value = daily if _CALENDAR[operation] == "D" else F.try_divide(F.sum(total).over(month), F.sum(count).over(month))
        days = days.withColumn(made[output], F.when(F.col("__day").isNotNull(), value) if _CALENDAR[operation] == "D" else value)
    days = days.select(F.col("__day").alias("__same"), *made.values())
    keyed = df.withColumn("__period", F.to_date(moment))
    joined = keyed.join(F.broadcast(days), keyed["__period"].eqNullSafe(days["__same"]), "left")
    kept = [ref(c) for c in df.columns if c not in made]
    return joined.select(*kept, *[F.col(inner).alias(output) for output, inner in made.items()])


def suggest_recipes(df: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """Recipes that the units, or a ``_k`` name ending, make likely.

    Units come from the ``units`` entry of each column's metadata; ``units`` overrides them.
    """
    found: list[tuple[str, str, str, str]] = []
    for f in df.schema.fields:
        unit = (units or {}).get(f.name, f.metadata.get("units"))
        unit = str(unit).strip().lower() if unit is not None else ""
        choice = fixed.UNIT_RECIPES.get(unit)
        if not unit and f.name.lower().endswith(fixed.KELVIN_NAME_SUFFIX):
            choice = ("kelvin_to_celsius", fixed.KELVIN_NAME_REASON)
        if choice is None:
            continue
        name = suggested_name(f.name, choice[0])
        if name not in df.columns:
            found.append((f.name, choice[0], name, choice[1]))
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame(
        found, "source_variable string, operation string, suggested_output string, reason string"
    )


def with_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Keeps each variable's unit with its column."""
    for column, unit in units.items():
        kept = {**df.schema[column].metadata, "units": unit}
        df = df.withMetadata(column, kept)
    return df
