"""Shared handling of result bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.model import Result, Table


class Bundle:
    """Collects what an analysis shares between its tables.

    Unchecked (the default) everything stays lazy and an input that is too small gives NULLs or no rows. Checked, the
    shared small table is persisted, so that all result tables come from one scan, and inputs that are too small
    raise ``ValueError``.
    """

    def __init__(self, checked: bool) -> None:
        self.checked = checked
        self.held: list[DataFrame] = []

    def hold(self, small: DataFrame) -> DataFrame:
        if not self.checked:
            return small
        kept = small.persist()
        self.held.append(kept)
        return kept

    def require(self, table: Table, column: str, at_least: int, what: str) -> None:
        if not self.checked:
            return
        row = (table if isinstance(table, DataFrame) else table()).select(column).head()
        found = row[0] if row else 0
        if (found or 0) < at_least:
            self.fail(f"At least {at_least} {what} are needed, found {found or 0}.")

    def require_coverage(self, groups: DataFrame, periods: bool = True) -> None:
        if not self.checked:
            return
        row = groups.agg(F.sum("count").alias("rows"), F.count_if(F.col("count") > 0).alias("periods")).head()
        if (row["rows"] or 0) < fixed.MIN_ROWS:
            self.fail(f"At least {fixed.MIN_ROWS} usable rows are needed, found {row['rows'] or 0}.")
        if periods and (row["periods"] or 0) < fixed.MIN_PERIODS:
            self.fail(f"At least {fixed.MIN_PERIODS} periods are needed, found {row['periods'] or 0}.")

    def fail(self, message: str) -> None:
        for table in self.held:
            table.unpersist()
        raise ValueError(message)

    def result(
        self,
        kind: str,
        facts: dict[str, Table] | None = None,
        records: dict[str, Table] | None = None,
        info: dict[str, object] | None = None,
    ) -> Result:
        return Result(kind, facts, records, info, self.held)
