"""A global, ordered, gap-free row number without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.session import ensure_checkpoint_dir

_LOCAL_BITS = 33


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column | str] = (),
    name: str = "row_index",
    partitions: int | None = None,
) -> tuple[DataFrame, int]:
    """The rows numbered 0, 1, 2, … in ``order_by`` order, and how many there are. Ties, or no order at all, follow
    the scan order.

    Rows are placed by range partitioning on the order key plus the scan position. That last part makes the key
    unique, so a run of equal times, however long, is spread over several partitions. The placed rows are written to
    the shared checkpoint folder, since partition numbers must not move between the counting and the reading
    pass. Only the size of each partition comes to the driver; the offsets go back as a broadcast of the same size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if order_by:
        keys = [F.col(k) if isinstance(k, str) else k for k in order_by]
        placed = df.withColumn("__scan", F.monotonically_increasing_id())
        keys = [*keys, F.col("__scan")]
        placed = (
            placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
        )
        placed = placed.sortWithinPartitions(*keys).drop("__scan")
    else:
        placed = df
    placed = placed.checkpoint(eager=True)
    tagged = placed.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("__at", _LOCAL_BITS)
    local = F.col("__at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    tagged = tagged.withColumn("__part", part).withColumn("__local", local).drop("__at")
    sizes = dict(tagged.groupBy("__part").agg(F.count(F.lit(1))).collect())
    total, offsets = 0, []
    for number in sorted(sizes):
        offsets.append((number, total))
        total += sizes[number]
    starts = spark.createDataFrame(offsets, "__part bigint, __offset bigint")
    indexed = (
        tagged.join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__local") + F.col("__offset"))
        .drop("__part", "__local", "__offset")
    )
    return indexed, total


def with_row_index(
    df: DataFrame,
    order_by: Sequence[Column | str] = (),
    name: str = "row_index",
    partitions: int | None = None,
) -> DataFrame:
    return number_rows(df, order_by, name, partitions)[0]
