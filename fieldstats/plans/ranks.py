"""Rows by their rank in a global order, without placing, writing or numbering the others."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a text that one code holds, exactly, in a double; and how many codes a text has at most.
_BYTES, _CHUNKS = 6, 4
#: A cell with more rows is divided further before its rows are sorted in one task.
_CROWDED = 1 << 20


@dataclass
class _Cell:
    """Rows between two bounds of the order. ``key`` is the first code that may differ within the cell."""

    number: int
    rows: int
    key: int = 0
    low: float = 0.0
    high: float = 0.0
    start: int = 0
    done: bool = False


def _codes(name: str, kind: T.DataType) -> list[Column]:
    """Doubles that follow the order of a column, coarsely: equal values have equal codes, and a smaller code is a smaller value. A further
    code decides only among rows alike in those before it. None for types without such a code."""
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(c).cast("double")]
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(c.cast("date")) * F.lit(86400.0)  # by its parts: a cast to an instant would depend on the zone
        return [day + F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c).cast("double")]
    if isinstance(kind, T.DateType):
        return [F.unix_date(c).cast("double")]
    if isinstance(kind, T.BooleanType):
        return [c.cast("int").cast("double")]
    if isinstance(kind, T.NumericType):
        return [c.cast("double")]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = c.cast("binary")
        pieces = [F.rpad(F.hex(F.substring(raw, 1 + k * _BYTES, _BYTES)), 2 * _BYTES, "0") for k in range(_CHUNKS)]
        return [F.conv(p, 16, 10).cast("double") for p in pieces]
    return []


class Ranks:
    """The cells of an order: ranges of its keys with the ranks they hold.

    The range of the first key is divided evenly into cells and the rows of each are counted, in one scan of the keys. A cell that is wanted
    and crowded is divided again, by the same key or, where that is constant, by the next; the scan position is the last
    key, so rows alike in all keys can be told apart too. Each level is a scan for all such cells together. Numbers of cells come to
    the driver, never rows. Only rows of wanted cells are then read, shuffled by cell and sorted there.

    Ties follow the scan order, which must be the same in every scan, as that of files is. Texts alike in their first bytes (24) lie
    in one cell, and so do columns of nested types; they are sorted there in one task.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str | Column], wanted: Callable[[int, int, int], bool], cells: int = 1 << 14) -> None:
        keys = [F.col(k) if isinstance(k, str) else k for k in order_by]
        self._df = df
        self._names = [f"__k{i}" for i in range(len(keys))]
        rows = df.withColumns({**dict(zip(self._names, keys)), "__scan": F.monotonically_increasing_id(), "__cell": F.lit(0).cast("long")})
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        codes: list[Column] = []
        self._barriers: dict[int, str] = {}  # after this code go on only if the whole column is constant
        for name in self._names:
            own = _codes(name, kinds[name])
            codes += own
            if isinstance(kinds[name], (T.StringType, T.BinaryType)):
                self._barriers[len(codes) - 1] = name
            if not own:
                break
        else:
            codes.append(F.col("__scan").cast("double"))
        self._codes = codes
        self._next, self._parent = 1, {}
        leaves = [_Cell(0, 0)]
        self._measure(rows, leaves)
        self.total = leaves[0].rows
        crowded = max(_CROWDED, 16 * self.total // cells)
        share = {0: cells}
        todo = [c for c in leaves if self._divisible(c) and wanted(0, c.rows, self.total)]
        while todo:
            rows = self._divide(rows, todo, share)
            fresh: dict[int, list[_Cell]] = {}
            for r in sorted(rows.where("__fresh").groupBy("__cell").count().collect()):
                fresh.setdefault(self._parent[r["__cell"]], []).append(_Cell(r["__cell"], r["count"]))
            leaves = [x for c in leaves for x in fresh.get(c.number, [c])]
            at = 0
            for c in leaves:
                c.start, at = at, at + c.rows
            full = [c for c in leaves if c.rows > crowded and not c.done and wanted(c.start, c.rows, self.total)]
            if full:
                self._measure(rows, full)
            todo = [c for c in full if self._divisible(c)]
            share = {c.number: min(cells, 16 * (c.rows // crowded + 1)) for c in todo}
        self._rows = rows
        self._chosen = [c for c in leaves if c.rows and wanted(c.start, c.rows, self.total)]

    def _divisible(self, cell: _Cell) -> bool:
        width = cell.high - cell.low
        cell.done = not cell.rows or cell.key >= len(self._codes) or not (width == 0 or 1e-290 < width < 1e290)
        return not cell.done

    def _measure(self, rows: DataFrame, cells: list[_Cell]) -> None:
        """The key by which each of the cells can be divided, and its range there."""
        parts: list[Column] = [F.count(F.lit(1)).alias("n")]
        for i, code in enumerate(self._codes):
            finite = F.when(~F.isnan(code) & (F.abs(code) != float("inf")), code)
            parts += [F.count(code).alias(f"c{i}"), F.min(code).alias(f"a{i}"), F.max(code).alias(f"b{i}"), F.min(finite).alias(f"l{i}"), F.max(finite).alias(f"h{i}")]
        for i, name in self._barriers.items():
            parts.append(F.min(name).eqNullSafe(F.max(name)).alias(f"e{i}"))
        if len(self._parent):
            which = rows.sparkSession.createDataFrame([(c.number,) for c in cells], "__cell long")
            rows = rows.join(F.broadcast(which), "__cell")
        known = {c.number: c for c in cells}
        for r in rows.groupBy("__cell").agg(*parts).collect():
            cell, key = known[r["__cell"]], 0
            while key < len(self._codes) and (r[f"c{key}"] == 0 or (r[f"c{key}"] == r["n"] and r[f"a{key}"] == r[f"b{key}"])):
                if key in self._barriers and not r[f"e{key}"]:
                    key = len(self._codes)
                    break
                key += 1
            low, high = (r[f"l{key}"], r[f"h{key}"]) if key < len(self._codes) else (None, None)
            cell.rows, cell.key = r["n"], key
            cell.low, cell.high = (low, high) if low is not None else (0.0, 0.0)

    def _divide(self, rows: DataFrame, todo: list[_Cell], share: dict[int, int]) -> DataFrame:
        """New cell numbers for the rows of ``todo``: null, -inf, even steps from low to high, inf and NaN, in this order."""
        table = []
        self._parent = {}
        for c in todo:
            count = share[c.number]
            scale = count / (c.high - c.low) if c.high > c.low else 0.0
            table.append((c.number, self._next, c.key, c.low, scale, count))
            self._parent |= dict.fromkeys(range(self._next, self._next + count + 4), c.number)
            self._next += count + 4
        shape = "__old long, __base long, __key int, __low double, __scale double, __count long"
        rules = F.broadcast(rows.sparkSession.createDataFrame(table, shape))
        rows = rows.drop("__fresh").join(rules, F.col("__cell") == F.col("__old"), "left")
        code = self._codes[0]
        for i, other in enumerate(self._codes[1:], 1):
            code = F.when(F.col("__key") == i, other).otherwise(code)
        step = F.least(F.floor((code - F.col("__low")) * F.col("__scale")), F.col("__count") - 1)
        place = (
            F.when(code.isNull(), 0)
            .when(F.isnan(code), F.col("__count") + 3)
            .when(code == float("inf"), F.col("__count") + 2)
            .when(code == float("-inf"), 1)
            .otherwise(step + 2)
        )
        fresh = F.col("__base").isNotNull()
        cell = F.when(fresh, F.col("__base") + place).otherwise(F.col("__cell"))
        return rows.withColumns({"__fresh": fresh, "__cell": cell}).drop("__old", "__base", "__key", "__low", "__scale", "__count")

    def rows(self, name: str) -> DataFrame:
        """The rows of all wanted cells with their rank from 0 in ``name``. A lazy plan."""
        chosen = [(c.number, c.start) for c in self._chosen]
        starts = F.broadcast(self._df.sparkSession.createDataFrame(chosen, "__cell long, __start long"))
        order = Window.partitionBy("__cell").orderBy(*self._names, "__scan")
        found = self._rows.join(starts, "__cell").withColumn(name, F.col("__start") + F.row_number().over(order) - 1)
        return found.select(*[F.col("`" + c.replace("`", "``") + "`") for c in self._df.columns], name)


def systematic_sample(df: DataFrame, size: int, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """``size`` rows evenly spaced over the order, first and last included; all rows when there are no more. Counting scans of
    the order's columns say where these rows lie; nothing else is read of the others, and nothing is written."""
    if size < 1:
        raise ValueError("The sample size must be at least 1.")
    spots: list[int] = []

    def wanted(start: int, rows: int, total: int) -> bool:
        if total <= size:
            return False
        if not spots:
            spots.extend([0] if size == 1 else [int(j * ((total - 1) / (size - 1))) for j in range(size - 1)] + [total - 1])
        at = bisect_left(spots, start)
        return at < len(spots) and spots[at] < start + rows

    ranks = Ranks(df, order_by, wanted, min(1 << 18, max(1 << 12, 16 * size)))
    if ranks.total <= size:
        return df
    return ranks.rows("__row").where(takes_row(F.col("__row"), ranks.total, size)).drop("__row")


def ranked_between(df: DataFrame, order_by: Sequence[str | Column], first: int, count: int) -> DataFrame:
    """The rows of rank ``first`` to ``first + count - 1``."""

    def wanted(start: int, rows: int, total: int) -> bool:
        return start < first + count and first < start + rows

    found = Ranks(df, order_by, wanted).rows("__row")
    return found.where(F.col("__row").between(first, first + count - 1)).drop("__row")


def takes_row(row: Column, total: int | Column, size: int) -> Column:
    """Is ``row`` one of trunc(j * (total-1)/(size-1)) for j = 0 … size-1? Needs ``total`` > ``size``."""
    if size == 1:
        return row == 0
    step = (F.lit(total).cast("double") - 1) / F.lit(float(size - 1))
    nearest = F.floor(F.try_divide(row, step))
    taken = row == F.lit(total) - 1
    for k in (-1, 0, 1, 2):
        j = nearest + k
        taken = taken | ((F.floor(j * step) == row) & j.between(0, size - 2))
    return taken
