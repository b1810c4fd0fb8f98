"""Connected components by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, for every node of ``edges`` (two columns of one orderable
    type). Rows with a null end are no links; self-links and repeated links are welcome. No edges, no rows.

    Alternates two steps until neither changes a link. Large-star: every node ties its larger neighbours to the
    smallest node it sees. Small-star: it ties its smaller neighbours, and itself, to that one. Each needs a minimum per
    node, found by partial aggregation, and a join; no node's neighbours are ever gathered, so a hub of any degree is a
    number of short rows, which adaptive execution may split. Every round is saved, so that a lost executor
    repeats one round at most. The number of rounds grows with the logarithm of the longest chain.
    """
    links = saved(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
        .where(F.col("ok") & (F.col("hi") != F.col("lo")))
        .select("hi", "lo")
        .distinct()
    )
    nodes = links
    before = None
    while True:
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("x")).unionAll(links.select(F.col("lo").alias("n"), F.col("hi").alias("x")))
        least = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
        large = both.where(F.col("x") > F.col("n")).join(least, "n").select(F.col("x").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where(F.col("hi") != F.col("lo"))
            .distinct()
        )
        links = saved(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    every = nodes.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    return every.join(links.select(F.col("hi").alias("node"), F.col("lo").alias("__lo")), "node", "left").select("node", F.coalesce("__lo", "node").alias("root"))
