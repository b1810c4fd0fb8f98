"""Distribution of daily means by decade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions import bins as binning
from fieldstats.functions.calendar import decade, decade_label
from fieldstats.functions.options import option
from fieldstats.model import Result, Roles
from fieldstats.operators.common import Bundle
from fieldstats.plans import periods
from fieldstats.plans.series import series

_QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def decade_statistics(days: DataFrame) -> DataFrame:
    """Exact quantiles are safe here: a decade has at most 3653 days."""
    start = decade(F.year("period"))
    quantiles = F.percentile("mean", F.array(*[F.lit(q) for q in _QUANTILES.values()]))
    stats = days.groupBy(start.alias("decade")).agg(
        F.count("mean").alias("count"),
        F.avg("mean").alias("mean"),
        F.stddev_samp("mean").alias("std"),
        F.min("mean").alias("min"),
        F.max("mean").alias("max"),
        quantiles.alias("q"),
    )
    return stats.select(
        "decade",
        decade_label(F.col("decade")).alias("label"),
        "count",
        "mean",
        "std",
        "min",
        *[F.col("q")[i].alias(name) for i, name in enumerate(_QUANTILES)],
        "max",
    )


def decade_histograms(days: DataFrame, bins: int) -> DataFrame:
    """Density of each decade on the same equal-width bins; empty bins are listed with density 0."""
    low, high = binning.widen_histogram(F.min("mean").over(periods.whole()), F.max("mean").over(periods.whole()))
    placed = days.select(decade(F.year("period")).alias("decade"), "mean", low.alias("low"), high.alias("high"))
    placed = placed.withColumn("bin", binning.left_closed(F.col("mean"), F.col("low"), F.col("high"), bins))
    filled = placed.groupBy("decade", "bin").agg(
        F.count(F.lit(1)).alias("count"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    # One row per decade carrying its bins; at most ``bins`` entries each.
    packed = filled.groupBy("decade").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("counts"),
        F.sum("count").alias("total"),
        F.first("low").alias("low"),
        F.first("high").alias("high"),
    )
    spread = packed.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    left = binning.edge(F.col("bin"), F.col("low"), F.col("high"), bins)
    right = binning.edge(F.col("bin") + 1, F.col("low"), F.col("high"), bins)
    count = F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0))
    return spread.select(
        "decade",
        decade_label(F.col("decade")).alias("label"),
        "bin",
        left.alias("left"),
        right.alias("right"),
        count.alias("count"),
        (count / (F.col("total") * (right - left))).alias("density"),
    )


def histogram_steps(histograms: DataFrame) -> DataFrame:
    """Outline of each histogram: two points per bin, ``step`` giving their order."""
    points = F.array(
        F.struct((F.col("bin") * 2).alias("step"), F.col("left").alias("x"), F.col("density").alias("y")),
        F.struct((F.col("bin") * 2 + 1).alias("step"), F.col("right").alias("x"), F.col("density").alias("y")),
    )
    return histograms.select("decade", F.explode(points).alias("p")).select("decade", "p.*")


def decade_summary(stats: DataFrame) -> DataFrame:
    record = F.struct(*[F.col(c) for c in stats.columns])
    named = stats.agg(
        F.min_by(record, "decade").alias("first_decade"),
        F.max_by(record, "decade").alias("last_decade"),
        F.min_by(record, F.struct("mean", "decade")).alias("lowest_mean_decade"),
        F.max_by(record, F.struct(F.col("mean"), -F.col("decade"))).alias("highest_mean_decade"),
        F.count(F.lit(1)).alias("observed_decades"),
    )
    return named.withColumn("mean_shift_first_to_last", F.col("last_decade.mean") - F.col("first_decade.mean"))


def decadal_distributions(
    df: DataFrame,
    time: str | None = None,
    target: str | None = None,
    roles: Roles | None = None,
    bins: object = None,
    checked: bool = False,
) -> Result:
    roles = roles or Roles()
    time, target = time or roles.time, target or roles.target
    count = int(option(bins, fixed.HISTOGRAM_BINS, whole=True))
    bundle = Bundle(checked)
    groups = bundle.hold(periods.period_groups(series(df, time, target), "D"))
    bundle.require_coverage(groups)
    days = periods.observed(groups)
    return bundle.result(
        "decadal_distributions",
        facts={
            "coverage": lambda: periods.coverage(groups, "daily_periods"),
            "summary": lambda: decade_summary(decade_statistics(days)),
        },
        records={
            "decadal_statistics": lambda: decade_statistics(days),
            "decadal_histograms": lambda: decade_histograms(days, count),
            "histogram_steps": lambda: histogram_steps(decade_histograms(days, count)),
        },
        info={"time_column": time, "target_column": target, "bins": count},
    )
