"""Equal-width bins computed by arithmetic, so a row never walks an edge list.

The bin index is guessed by division and then moved by at most one, so that it agrees exactly with the edge
values ``low + i * width`` even where the division rounds the other way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge(index: Column, low: Column, high: Column, bins: int) -> Column:
    width = (high - low) / F.lit(bins)
    return F.when(index >= bins, high).otherwise(index * width + low)


def left_closed(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins [a, b), the last one [a, b]: the rule of a density histogram."""
    width = (high - low) / F.lit(bins)
    guess = F.floor(F.try_divide(value - low, width)).cast("int")
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), guess))
    moved = (
        F.when(value < edge(guess, low, high, bins), guess - 1)
        .when(value >= edge(guess + 1, low, high, bins), guess + 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), moved))


def right_closed(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins (a, b], the smallest value in bin 0: the rule of an interval cut."""
    width = (high - low) / F.lit(bins)
    guess = (F.ceil(F.try_divide(value - low, width)) - 1).cast("int")
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), guess))
    moved = (
        F.when(value <= edge(guess, low, high, bins), guess - 1)
        .when(value > edge(guess + 1, low, high, bins), guess + 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), moved))


def widen_histogram(low: Column, high: Column) -> tuple[Column, Column]:
    """Equal bounds are moved half a unit apart each way."""
    flat = low == high
    return F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)


def widen_cut(low: Column, high: Column) -> tuple[Column, Column]:
    """Equal bounds are moved by 0.1 % of their size, or 0.001 at zero."""
    flat = low == high
    pad = F.when(low == 0, F.lit(0.001)).otherwise(F.abs(low) * 0.001)
    return F.when(flat, low - pad).otherwise(low), F.when(flat, high + pad).otherwise(high)
