"""Row-frame windows over one global order, computed in parallel blocks.

``Window.orderBy`` without a partition key sends every row to one task. Here rows are numbered globally, cut into
blocks of consecutive rows, and each block also receives copies of the last rows of the block before it (the
halo), so that a frame reaching back never leaves its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 262_144
# Frames up to this many rows are summed directly; longer ones are put together from running sums.
DIRECT_FRAME = 128


def blocks_with_halo(indexed: DataFrame, reach: int, index: str = "row_index", block_rows: int | None = None) -> DataFrame:
    """Adds ``__block`` and ``__copy``; rows in the last ``reach`` places of a block also appear in the next."""
    size = max(block_rows or BLOCK_ROWS, reach, 1)
    home = F.floor(F.col(index) / F.lit(size)).cast("long")
    place = F.col(index) % F.lit(size)
    targets = F.when(place >= size - reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        indexed.withColumn("__copy", F.explode(targets))
        .withColumn("__block", home + F.col("__copy"))
    )


def rolling_mean(
    indexed: DataFrame,
    value: Column,
    window: int,
    output: str,
    index: str = "row_index",
    block_rows: int | None = None,
) -> DataFrame:
    """Mean of the last ``window`` rows that have a value; NULL when none of them has."""
    reach = window - 1 if window <= DIRECT_FRAME else window
    staged = blocks_with_halo(indexed.withColumn("__v", value), reach, index, block_rows)
    in_block = Window.partitionBy("__block").orderBy(index)
    if window <= DIRECT_FRAME:
        rolled = staged.withColumn("__out", F.avg("__v").over(in_block.rowsBetween(-(window - 1), 0)))
    else:
        rolled = _long_frame(staged, window, index, in_block)
    return rolled.where(F.col("__copy") == 0).withColumn(output, F.col("__out")).select(
        *[F.col("`" + c + "`") for c in indexed.columns if c != output], F.col(output)
    )


def _long_frame(staged: DataFrame, window: int, index: str, in_block: Window) -> DataFrame:
    """Constant work per row for any frame length.

    With stretches of ``window`` rows, a frame is the end of one stretch plus the start of the next: the running sum
    up to this row, plus what followed the row ``window`` places back within its stretch. Only additions, so nothing
    cancels.
    """
    stretch = F.floor(F.col(index) / F.lit(window))
    staged = staged.withColumn("__stretch", stretch)
    forward = Window.partitionBy("__block", "__stretch").orderBy(index)
    up_to = forward.rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("__block", "__stretch").orderBy(F.col(index).desc())
    after = backward.rowsBetween(Window.unboundedPreceding, -1)
    staged = (
        staged.withColumn("__s", F.coalesce(F.sum("__v").over(up_to), F.lit(0.0)))
        .withColumn("__n", F.count("__v").over(up_to))
        .withColumn("__rs", F.coalesce(F.sum("__v").over(after), F.lit(0.0)))
        .withColumn("__rn", F.count("__v").over(after))
    )
    total = F.col("__s") + F.coalesce(F.lag("__rs", window).over(in_block), F.lit(0.0))
    count = F.col("__n") + F.coalesce(F.lag("__rn", window).over(in_block), F.lit(0))
    return staged.withColumn("__out", F.try_divide(total, count))


def lagged(
    indexed: DataFrame,
    value: str,
    lags: int,
    index: str = "row_index",
    block_rows: int | None = None,
) -> DataFrame:
    """Adds ``lag_1 … lag_p``: the value that many rows earlier."""
    staged = blocks_with_halo(indexed, lags, index, block_rows)
    in_block = Window.partitionBy("__block").orderBy(index)
    columns = {f"lag_{k}": F.lag(value, k).over(in_block) for k in range(1, lags + 1)}
    return staged.withColumns(columns).where(F.col("__copy") == 0).drop("__copy", "__block")
