"""Merging group statistics into coarser groups without reading the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_groups(groups: DataFrame, *keys: str) -> DataFrame:
    """Mean, standard deviation, min, max and count of unions of groups.

    ``groups`` carries mean, m2 (sum of squared deviations), min, max and count per fine group. Deviations are taken
    from the merged mean first, so nothing is lost to cancellation.
    """
    same = Window.partitionBy(*keys)
    weighted = F.sum(F.col("mean") * F.col("count")).over(same) / F.sum("count").over(same)
    centred = groups.withColumn("centre", weighted)
    square = F.sum(F.col("m2") + F.col("count") * F.pow(F.col("mean") - F.col("centre"), 2))
    total = F.sum("count")
    return centred.groupBy(*keys).agg(
        F.first("centre").alias("mean"),
        F.when(total > 1, F.sqrt(F.try_divide(square, total - 1))).alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        total.alias("count"),
    )
