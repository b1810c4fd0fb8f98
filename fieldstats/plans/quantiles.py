"""Exact quantiles of unbounded columns.

The built-in exact ``percentile`` keeps every distinct value in one buffer, which does not survive a column with
billions of them. Here mergeable sketches, taken in the scan that also finds counts, ends and moments, bracket each wanted quantile. The
exact pass, a second scan, then counts the distinct values inside the brackets, and everything between two brackets as one
group; a running count over that small table finds the order statistics. The groups between brackets carry exact counts,
so a bracket that misses its quantile shows, and is replaced by the whole range. When a bracket may hold too many
values, further sketch passes narrow it. Each pass is one scan with map-side aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Items of a sketch. Ranks are off by about 0.13 % of the rows; brackets reach twice as far.
SKETCH_ITEMS = 4096
MARGIN = 0.003
# Up to this many rows the whole range is used instead of a bracket.
SMALL = 2_000
# Most distinct values that the brackets of one column may hold in the exact pass.
KEPT_VALUES = 1_000_000
NARROW_GRID = 4096
_ATTEMPTS = 4


@dataclass
class _Bracket:
    column: str
    probability: float
    low: float
    high: float
    rows: float  # upper estimate of the rows inside
    floor: float
    ceiling: float

    def widen(self, rows: int) -> None:
        self.low, self.high, self.rows = self.floor, self.ceiling, rows


def _even_steps(count: int) -> Column:
    """0 to 1 in ``count`` equal steps, as one parsed constant rather than thousands of literal columns."""
    return F.expr("array(" + ",".join(f"{g / count!r}D" for g in range(count + 1)) + ")")


def first_scan(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], parts: Sequence[Column] = ()) -> Row:
    """One row: count, ends and brackets of the wanted quantiles of each column, and whatever ``parts`` adds up beside them."""
    marks = F.array(*[F.lit(min(max(p + side * MARGIN, 0.0), 1.0)) for p in probabilities for side in (-1, 1)])
    found, shown = list(parts), [F.col("*")]
    for i, name in enumerate(columns):
        found += [F.count(name).alias(f"n_{i}"), F.min(name).alias(f"low_{i}"), F.max(name).alias(f"high_{i}")]
        found.append(F.kll_sketch_agg_double(name, F.lit(SKETCH_ITEMS)).alias(f"sketch_{i}"))
        shown.append(F.when(F.col(f"n_{i}") > 0, F.kll_sketch_get_quantile_double(f"sketch_{i}", marks)).alias(f"marks_{i}"))
    return df.agg(*found).select(*shown).drop(*[f"sketch_{i}" for i in range(len(columns))]).head()


def finish(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    known: Row,
    kept_values: int = KEPT_VALUES,
) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation) of NaN-free double columns, from the row of their ``first_scan``."""
    counts = {name: known[f"n_{i}"] for i, name in enumerate(columns)}
    brackets: list[_Bracket] = []
    for i, name in enumerate(columns):
        if not counts[name]:
            continue
        low, high = known[f"low_{i}"], known[f"high_{i}"]
        for k, p in enumerate(probabilities):
            bracket = _Bracket(name, p, low, high, counts[name], low, high)
            if counts[name] > SMALL:
                # Beyond the ends of the sketch lie the ends of the column.
                bracket.low = known[f"marks_{i}"][2 * k] if p > MARGIN else low
                bracket.high = known[f"marks_{i}"][2 * k + 1] if p < 1 - MARGIN else high
                bracket.rows = 4 * MARGIN * counts[name]
            brackets.append(bracket)
    found: dict[tuple[str, float], float] = {}
    for _ in range(_ATTEMPTS):
        todo = [b for b in brackets if (b.column, b.probability) not in found]
        if not todo:
            break
        while any(b.rows > kept_values and b.low < b.high for b in todo):
            if not _narrow(df, todo, counts, kept_values):
                break
        found.update(_exact_pass(df, todo, counts))
        for b in todo:
            if (b.column, b.probability) not in found:
                b.widen(counts[b.column])
    else:
        if len(found) < len(brackets):
            raise ArithmeticError("The sketches kept missing a quantile.")
    return {c: [found.get((c, p)) for p in probabilities] for c in columns}


def _ranks(count: int, probability: float) -> tuple[int, int, float]:
    position = (count - 1) * probability
    return math.floor(position), math.ceil(position), position


def _narrow(df: DataFrame, brackets: list[_Bracket], counts: dict[str, int], limit: int) -> bool:
    """One more sketch pass over the values inside the brackets that are still too full."""
    todo = [b for b in brackets if b.rows > limit and b.low < b.high]
    grid = _even_steps(NARROW_GRID)
    parts: list[Column] = []
    for i, b in enumerate(todo):
        value = F.col(b.column)
        inside = value.between(b.low, b.high)
        parts += [
            F.count_if(value < b.low).alias(f"below_{i}"),
            F.count_if(inside).alias(f"inside_{i}"),
            F.percentile_approx(F.when(inside, value), grid, ACCURACY).alias(f"grid_{i}"),
        ]
    row = df.agg(*parts).head()
    moved = False
    for i, b in enumerate(todo):
        below, inside, marks = row[f"below_{i}"], row[f"inside_{i}"], row[f"grid_{i}"]
        first, last, _ = _ranks(counts[b.column], b.probability)
        if not (below <= first and last < below + inside):
            b.widen(counts[b.column])
            moved = True
            continue
        span = max(inside - 1, 1)
        # The sketch may be off by inside / ACCURACY ranks; one grid step more than that on each side.
        slack = 1 + math.ceil(NARROW_GRID / ACCURACY)
        left = max(math.floor((first - below) / span * NARROW_GRID) - slack, 0)
        right = min(math.ceil((last - below) / span * NARROW_GRID) + slack, NARROW_GRID)
        low = b.low if left == 0 else marks[left]
        high = b.high if right == NARROW_GRID else marks[right]
        moved = moved or low > b.low or high < b.high
        b.low, b.high = low, high
        b.rows = inside * ((right - left) / NARROW_GRID + 2 / ACCURACY)
    return moved


def _spans(brackets: list[_Bracket]) -> list[tuple[float, float]]:
    """The brackets of one column as ascending, disjoint spans."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted((b.low, b.high) for b in brackets):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def _tally(spans: list[tuple[np.ndarray, np.ndarray]]):
    """mapInArrow: for each column the distinct values inside its spans with their numbers, and how many values lie in each gap. Zone 2i is
    the gap before span i, 2i + 1 is span i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = [np.zeros(2 * len(low) + 1, np.int64) for low, _ in spans]

        def rows(k: int, zone: np.ndarray, value: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(zone), k, np.int32)), pa.array(zone.astype(np.int32)), value, pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["k", "zone", "v", "n"])

        for batch in batches:
            for k, (low, high) in enumerate(spans):
                v = batch[k].drop_null().to_numpy(zero_copy_only=False)
                at = np.searchsorted(low, v, side="right") - 1
                inside = (at >= 0) & (v <= high[np.maximum(at, 0)])
                gaps[k] += np.bincount(2 * (at[~inside] + 1), minlength=len(gaps[k]))
                value, n = np.unique(v[inside], return_counts=True)
                if len(value):
                    yield rows(k, 2 * np.searchsorted(low, value, side="right") - 1, pa.array(value), n)
        for k, counted in enumerate(gaps):
            zone = np.flatnonzero(counted)
            yield rows(k, zone, pa.nulls(len(zone), pa.float64()), counted[zone])

    return run


def _exact_pass(df: DataFrame, brackets: list[_Bracket], counts: dict[str, int]) -> dict[tuple[str, float], float]:
    """The quantiles whose order statistics both lie inside a bracket. One scan."""
    names = list(dict.fromkeys(b.column for b in brackets))
    spans = [_spans([b for b in brackets if b.column == name]) for name in names]
    wanted: Column = F.lit(False)
    for k, name in enumerate(names):
        own = [b for b in brackets if b.column == name]
        for rank in {r for b in own for r in _ranks(counts[name], b.probability)[:2]}:
            covers = (F.col("before") <= rank) & (F.col("upto") > rank)
            wanted = wanted | ((F.col("k") == k) & covers)
    ends = [(np.array([low for low, _ in own]), np.array([high for _, high in own])) for own in spans]
    cells = df.select(*[F.col(name).cast("double") for name in names]).mapInArrow(_tally(ends), "k int, zone int, v double, n bigint")
    sizes = cells.groupBy("k", "zone", "v").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("k").orderBy("zone", "v"))
    ranked = sizes.select("k", "v", running.alias("upto"), (running - F.col("n")).alias("before"))
    hits = ranked.where(wanted).collect()  # at most two rows per quantile

    def at(k: int, rank: int) -> float | None:
        return next((h["v"] for h in hits if h["k"] == k and h["before"] <= rank < h["upto"]), None)

    found: dict[tuple[str, float], float] = {}
    for b in brackets:
        k = names.index(b.column)
        first, last, position = _ranks(counts[b.column], b.probability)
        low, high = at(k, first), at(k, last)
        if low is not None and high is not None:
            found[b.column, b.probability] = low + (high - low) * (position - first)
    return found


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    kept_values: int = KEPT_VALUES,
) -> dict[str, list[float | None]]:
    return finish(df, columns, probabilities, first_scan(df, columns, probabilities), kept_values)
