"""Roles of columns and results of analyses."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats import fixed


@dataclass(frozen=True)
class Roles:
    """Which column is the time, the place, and the measured variables."""

    time: str | None = None
    latitude: str | None = None
    longitude: str | None = None
    variables: tuple[str, ...] = ()
    column_types: dict[str, str] = field(default_factory=dict)

    def override(
        self,
        time: str | None = None,
        latitude: str | None = None,
        longitude: str | None = None,
        variables: Iterable[str] = (),
    ) -> Roles:
        """All four roles are replaced, also by the defaults; only the column types stay."""
        return replace(self, time=time, latitude=latitude, longitude=longitude, variables=tuple(variables))

    def with_derived(self, names: Iterable[str]) -> Roles:
        """Roles after derived columns joined the table."""
        variables, types = list(self.variables), dict(self.column_types)
        for name in names:
            if name not in variables:
                variables.append(name)
            types.setdefault(name, "derived_numeric")
        return replace(self, variables=tuple(variables), column_types=types)

    @property
    def target(self) -> str | None:
        return self.variables[0] if self.variables else None

    def hinted(self, hints: Iterable[str]) -> str | None:
        hints = tuple(hints)
        return next((v for v in self.variables if any(h in v.lower() for h in hints)), None)


Table = DataFrame | Callable[[], DataFrame]


class Result:
    """A named set of lazy tables.

    ``facts`` are one-row tables, ``records`` are row tables. A table may be given as a function; it is built on
    first use. ``held`` are persisted tables shared by the others, freed by ``release()``.
    """

    def __init__(
        self,
        kind: str,
        facts: dict[str, Table] | None = None,
        records: dict[str, Table] | None = None,
        info: dict[str, object] | None = None,
        held: Iterable[DataFrame] = (),
    ) -> None:
        self.kind = kind
        self.info = dict(info or {})
        self._facts = dict(facts or {})
        self._records = dict(records or {})
        self._held = list(held)

    def __getitem__(self, name: str) -> DataFrame:
        for store in (self._facts, self._records):
            if name in store:
                if not isinstance(store[name], DataFrame):
                    store[name] = store[name]()
                return store[name]
        raise KeyError(f"'{self.kind}' has no table '{name}'. Tables: {', '.join(self.names())}")

    def __contains__(self, name: str) -> bool:
        return name in self._facts or name in self._records

    def add(self, name: str, table: Table) -> None:
        self._records[name] = table

    def names(self) -> list[str]:
        return [*self._facts, *self._records]

    def primary(self) -> DataFrame:
        """The one table that stands for the result in an export: the first listed one that has rows, else the matrix, else the facts."""
        for name in fixed.PRIMARY_TABLES:
            if name in self._records and not self[name].isEmpty():
                return self[name]
        if "matrix" in self._records:
            return self["matrix"]
        return self.flat()

    def flat(self) -> DataFrame:
        """All facts as one row; the columns of a section are named ``section.column``."""
        wide: DataFrame | None = None
        for name in self._facts:
            part = self[name]
            prefix = "" if name == "coverage" else f"{name}."
            part = part.select(*[c.alias(label) for c, label in leaves(part, prefix)])
            wide = part if wide is None else wide.crossJoin(part)
        if wide is None:
            raise ValueError(f"'{self.kind}' has no one-row facts to flatten.")
        fixed_columns = [F.lit(v).alias(k) for k, v in self.info.items() if isinstance(v, (str, int, float, bool))]
        return wide.select(*fixed_columns, *[F.col(f"`{c}`") for c in wide.columns])

    def release(self) -> None:
        for table in self._held:
            table.unpersist()
        self._held = []


def leaves(df: DataFrame, prefix: str = "") -> list[tuple[F.Column, str]]:
    """Leaf columns of a table with nested structs, each with its dotted name."""

    def walk(column: F.Column, data_type: T.DataType, label: str) -> list[tuple[F.Column, str]]:
        if not isinstance(data_type, T.StructType):
            return [(column, label)]
        found: list[tuple[F.Column, str]] = []
        for child in data_type.fields:
            found += walk(column.getField(child.name), child.dataType, f"{label}.{child.name}")
        return found

    out: list[tuple[F.Column, str]] = []
    for item in df.schema.fields:
        out += walk(F.col("`" + item.name + "`"), item.dataType, prefix + item.name)
    return out
