"""A table with its roles, recipes and origin."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.calendar import frequency as frequency_code
from fieldstats.functions.coerce import ref, require_times, timestamp
from fieldstats.functions.options import option
from fieldstats.model import Result, Roles
from fieldstats.operators import registry
from fieldstats.operators.aggregate import check_aggregations, temporal_aggregation, value_columns
from fieldstats.operators.recipes import Recipe, apply_recipes, make_recipe, suggest_recipes
from fieldstats.operators.roles import infer_roles
from fieldstats.sources import readers, sinks
from fieldstats.sources.standardize import standardize

# Analyses and charts that take every numeric column unless features are named, and those that choose a variable by name.
_WIDE = ("descriptive_stats", "correlation", "linear_regression", "random_forest_regression", "scatter", "heatmap")
_HINTED = ("temperature_trend", "precipitation_trend")


@dataclass(frozen=True)
class Dataset:
    """Immutable; changes return a new dataset over the same base table. Recipes are evaluated where they are read."""

    base: DataFrame
    roles: Roles
    name: str = "dataset"
    source_format: str = "table"
    recipes: tuple[Recipe, ...] = ()
    provenance: dict[str, object] = field(default_factory=dict)
    derived: tuple[str, ...] = ()
    dataset_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @classmethod
    def from_df(cls, df: DataFrame, roles: Roles | None = None, name: str = "dataset", **more: object) -> Dataset:
        return cls(df, roles or infer_roles(df), name, **more)

    @classmethod
    def read(cls, spark: SparkSession, path: str, format: str | None = None, roles: Roles | None = None) -> Dataset:
        """Read, standardise and infer roles."""
        kind = format or readers.detect_format(path)
        df = standardize(readers.read_table(spark, path, kind))
        return cls.from_df(df, roles, PurePosixPath(path).name, source_format=kind)

    @property
    def derived_columns(self) -> list[str]:
        return list(dict.fromkeys([*self.derived, *(r.output for r in self.recipes)]))

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.base.columns, *(r.output for r in self.recipes)]))

    @property
    def mapping(self) -> Roles:
        """The roles with derived columns added."""
        return self.roles.with_derived(self.derived_columns)

    def df(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The table with its recipes; with ``columns``, only the recipes those need are run."""
        if columns is None:
            return apply_recipes(self.base, self.recipes, self.roles)
        needed, used = set(columns), []
        for recipe in reversed(self.recipes):
            if recipe.output in needed:
                used.append(recipe)
                needed |= {recipe.source, str(recipe.parameters.get("time_column", recipe.source))}
                needed |= set(recipe.parameters.get("order_by", ()))
        slim = self.base.select(*[ref(c) for c in self.base.columns if c in needed])
        return apply_recipes(slim, used[::-1], self.roles).select(*[ref(c) for c in columns])

    def _with(self, names: Iterable[object]) -> DataFrame:
        """The named columns and no others: a rolling recipe that is read then writes and orders only these and what it needs."""
        wanted = set(names)
        return self.df([c for c in self.columns if c in wanted])

    def _read_by(self, kind: str, options: dict[str, object]) -> DataFrame:
        """The table for an analysis or chart: recipes run only for columns that its options or roles name. What takes all
        numeric columns unless told otherwise gets all of them."""
        named: list[object] = []
        for value in options.values():
            named += [value] if isinstance(value, str) else list(value) if isinstance(value, (list, tuple)) else []
        if kind in _WIDE and not options.get("features"):
            return self.df()
        roles = self.mapping
        picked = roles.variables if kind in _HINTED else (roles.target,)
        return self._with([*named, roles.time, roles.latitude, roles.longitude, *picked])

    def set_roles(self, **roles: object) -> Dataset:
        return replace(self, roles=self.roles.override(**roles))

    def add_recipe(self, source: str, operation: str, output: str | None = None, **parameters: object) -> Dataset:
        """A checked recipe; its column joins the variables. The column is computed where it is read; only a time
        column is probed, up to its first readable cell."""
        if source not in self.columns:
            raise ValueError(f"Source column '{source}' is not in the dataset.")
        recipe = make_recipe(source, operation, output, self.mapping, **parameters)
        if recipe.output in self.columns:
            raise ValueError(f"Column '{recipe.output}' exists already.")
        time = recipe.parameters.get("time_column")
        if time and time not in self.columns:
            raise ValueError(f"Time column '{time}' is not in the dataset.")
        if time in self.base.columns:
            require_times(self.base, time)
        return replace(self, recipes=(*self.recipes, recipe))

    def suggestions(self, units: dict[str, str] | None = None) -> DataFrame:
        known = suggest_recipes(self.base, units)
        return known.where(~F.col("suggested_output").isin(self.columns)) if self.recipes else known

    def analyze(self, kind: str, checked: bool = True, **options: object) -> Result:
        return registry.analyze(self._read_by(kind, options), kind, self.mapping, checked=checked, **options)

    def chart(self, kind: str, **options: object) -> DataFrame:
        return registry.chart(self._read_by(kind, options), kind, self.mapping, **options)

    def temporal_aggregation(
        self,
        frequency: str = "D",
        columns: Sequence[str] | None = None,
        aggregations: Sequence[str] = fixed.DEFAULT_AGGREGATIONS,
        time: str | None = None,
        name: str | None = None,
    ) -> Dataset:
        """A new dataset with one row per period and a record of where it came from."""
        code = frequency_code(frequency)
        time = time or self.mapping.time
        source = self._with([time, *(columns or self.mapping.variables or self.columns)])
        aggregations = check_aggregations(aggregations)
        columns = value_columns(source, time, columns, self.mapping) if time else None
        table = temporal_aggregation(source, time, columns, code, aggregations, self.mapping, verify=False)
        outputs = [c for c in table.columns if c != "period_start"]
        roles = Roles("period_start", None, None, tuple(outputs), {"period_start": "time", **{c: "numeric" for c in outputs}})
        stem = PurePosixPath(self.name).stem
        return Dataset(
            table,
            roles,
            (name or "").strip() or f"{stem}_{fixed.FREQUENCY_LABELS[code]}",
            "derived",
            provenance={
                "source": "temporal_aggregation",
                "parent_dataset_id": self.dataset_id,
                "parent_dataset_name": self.name,
                "time_column": time,
                "value_columns": columns,
                "frequency": code,
                "aggregations": aggregations,
            },
            derived=tuple(outputs),
        )

    def input_rows(self, time: str | None = None) -> DataFrame:
        """One row: rows read and rows with a usable time."""
        time = time or self.mapping.time
        source = self._with([time])
        moment = timestamp(source, time)
        return source.agg(F.count(F.lit(1)).alias("input_rows"), F.count(moment).alias("valid_time_rows"))

    def preview(
        self, order_by: Sequence[str], limit: object = None, offset: int = 0, after: Sequence[object] | None = None
    ) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of an order, or those behind the key values ``after``; NaN is shown as NULL."""
        size = int(option(limit, fixed.PREVIEW_ROWS, whole=True))
        if isinstance(limit, int) and limit > size:
            raise ValueError(f"A preview has at most {fixed.PREVIEW_ROWS[2]} rows; write the table to read more.")
        if offset < 0:
            raise ValueError("The offset must not be negative.")
        return sinks.page(self.df(), order_by, size, offset, after)

    def profile(self) -> DataFrame:
        """One row: id, name, format, creation time, row count, columns, derived columns, roles."""
        roles = self.mapping
        head = [
            (
                self.dataset_id,
                self.name,
                self.source_format,
                self.created_at,
                self.columns,
                self.derived_columns,
                roles.time,
                roles.latitude,
                roles.longitude,
                list(roles.variables),
            )
        ]
        schema = (
            "dataset_id string, name string, source_format string, created_at timestamp, columns array<string>, "
            "derived_columns array<string>, time_column string, latitude_column string, longitude_column string, "
            "climate_variables array<string>"
        )
        count = self.base.agg(F.count(F.lit(1)).alias("row_count"))
        return self.base.sparkSession.createDataFrame(head, schema).crossJoin(count)

    def write(self, path: str, mode: str = "errorifexists", partition_by_year: bool = False) -> None:
        time = self.mapping.time if partition_by_year else None
        sinks.write_parquet(self.df(), path, mode, time)

    def export_csv(self, path: str, mode: str = "errorifexists") -> None:
        sinks.write_csv(self.df(), path, mode)


def list_datasets(spark: SparkSession, datasets: Iterable[Dataset]) -> DataFrame:
    """Newest first. The rows of all of them are counted in one job, when the list is read."""
    known = list(datasets)
    rows = [(k, d.dataset_id, d.name, d.source_format, d.created_at, d.columns) for k, d in enumerate(known)]
    counts = spark.createDataFrame([], "k int, row_count bigint")
    for k, d in enumerate(known):
        counts = counts.unionAll(d.base.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("row_count")))
    shape = "k int, dataset_id string, name string, source_format string, created_at timestamp, columns array<string>"
    listed = counts.join(F.broadcast(spark.createDataFrame(rows, shape)), "k")
    return listed.select("dataset_id", "name", "source_format", "created_at", "row_count", "columns").orderBy(F.col("created_at").desc())
