"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import WORD, ref, saved

#: Hash slices of each source; only the slice in which a source's share runs out is ordered row by row.
SLICES = 1 << 16
#: Sources up to this many go to every task with their facts (some 100 bytes each); more are joined by a shuffle.
SENT_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``target`` to a table with ``size`` and ``weight`` per source: the total of all sizes shared by weight, no target over
    ``max_epochs`` times its size; what a source cannot take is shared again by weight among those below their limit.

    Each round is one aggregation to three numbers, the words that are left, the weight that is still open and how many
    sources are at their limit; it ends when no further source reaches its limit. With ``max_epochs`` >= 1 all
    words find a place.
    """
    limit = F.col("size") * F.lit(float(max_epochs))
    level = None
    full = -1
    while True:
        held = F.lit(False) if level is None else limit <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("size").alias("all"),
            F.sum(F.when(held, limit).otherwise(0.0)).alias("taken"),
            F.sum(F.when(held, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(held.cast("long")).alias("full"),
        ).first()
        if row["all"] is None or not row["open"] or row["full"] == full:
            break
        full = row["full"]
        level = (row["all"] - row["taken"]) / row["open"]
    share = F.col("weight") * F.lit(level or 0.0)
    return sources.withColumn("target", F.least(limit, share))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``, 0, 1, … by code point, null last, without one task that sees all sources: sources are counted by
    range partition, and each partition starts where those before it end."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = saved(sources.repartitionByRange(*order)).withColumn("__part", F.spark_partition_id())
    placed = saved(placed)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))  # a row per partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return placed.join(F.broadcast(starts), "__part").withColumn("place", own + F.col("__start")).drop("__part", "__start")


def _marked(docs: DataFrame, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """The row as ``__row`` and the struct ``__mix``: id, source, size and the key that orders the documents of a source."""
    text, own = ref(text_col).cast("string"), ref(id_col).cast("string")
    key = F.xxhash64(F.lit(seed), own, F.coalesce(F.xxhash64(text), F.lit(0)))
    mark = F.struct(
        ref(id_col).cast("long").alias("id"),
        ref(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        key.alias("key"),
        F.shiftrightunsigned(key, 64 - (SLICES.bit_length() - 1)).alias("slice"),
    )
    return docs.select(F.struct(*[ref(c) for c in docs.columns]).alias("__row"), mark.alias("__mix"))


def _facts(slim: DataFrame, cycle: tuple[float, ...], max_epochs: float) -> DataFrame:
    """A row per source: size, target, whole repetitions, the words of the fractional one (``part``), the slice in which those
    run out (``edge``) and the words before it (``ahead``)."""
    slices = saved(slim.groupBy("__mix.source", "__mix.slice").agg(F.sum("__mix.size").alias("size")))
    ranked = saved(_ranked(slices.groupBy("source").agg(F.sum("size").alias("size"))))
    weight = F.element_at(F.lit([float(w) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    rate = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("size"), F.lit(float(max_epochs)))).otherwise(0.0)
    filled = water_fill(ranked.withColumn("weight", weight), max_epochs).withColumn("whole", F.floor(rate).cast("long"))
    filled = saved(filled.withColumn("part", F.col("target") - F.col("whole") * F.col("size")))
    reach = Window.partitionBy("source").orderBy("slice")
    run = slices.select(F.col("source").alias("r_source"), "slice", F.col("size").alias("n"), (F.sum("size").over(reach) - F.col("size")).alias("ahead"))
    edges = (
        run.join(filled.select("source", "part"), F.col("r_source").eqNullSafe(F.col("source")))
        .where((F.col("ahead") < F.col("part")) & (F.col("ahead") + F.col("n") >= F.col("part")))
        .groupBy("source")
        .agg(F.min(F.struct("slice", "ahead")).alias("e"))
        .select(F.col("source").alias("l_source"), "e.slice", "e.ahead")
    )
    facts = filled.join(edges, F.col("source").eqNullSafe(F.col("l_source")), "left").select(
        F.struct(
            "source", F.col("size").alias("source_size"), "target", "whole", "part",
            F.coalesce("slice", F.lit(-1)).alias("edge"), F.coalesce("ahead", F.lit(0)).alias("ahead"),
        ).alias("__fact")
    )
    return saved(facts)


def _repeated(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds ``__fact`` of the source and ``__repeats`` to marked rows; rows stay where they are, but for those of the edge slices."""
    few = facts.count() <= SENT_SOURCES
    rows = rows.join(F.broadcast(facts) if few else facts, F.col("__mix.source").eqNullSafe(F.col("__fact.source")))
    whole, size = F.col("__fact.whole"), F.col("__mix.size")
    order = Window.partitionBy("__mix.source").orderBy("__mix.key", "__mix.id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("__fact.ahead") + F.sum(size).over(order) - size
    edge = rows.where(F.col("__mix.slice") == F.col("__fact.edge")).withColumn("__repeats", whole + (before + size / 2 <= F.col("__fact.part")).cast("long"))
    rest = rows.where(F.col("__mix.slice") != F.col("__fact.edge"))
    rest = rest.withColumn("__repeats", whole + (F.col("__mix.slice") < F.col("__fact.edge")).cast("long"))
    return rest.unionByName(edge).withColumn("__repeats", F.when(size > 0, F.col("__repeats")).otherwise(0))


def mix_counts(
    docs: DataFrame,
    cycle: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """How often each document goes into the mix: a row per row of ``docs`` with the id, ``size`` (words), ``source_size``, ``target`` of
    its source, ``repeats`` (whole number) and ``taken`` (``size * repeats``).

    Sources in code-point order, null last, weigh ``cycle``, repeated. Their targets share all words by weight with at most
    ``max_epochs`` repetitions, see ``water_fill``. A source's documents are put in a seeded random order. Each is taken
    ``floor(target / size)`` times, and the documents that come first, up to the one that ends nearest to the missing
    words, once more: the words taken differ from the target by half a document at most.

    The order needs no sort of a source: words are summed by hash slice, the slice in which the target is met follows
    from their running sums, and only that slice (1/65536 of a source) is ordered. Reruns, other partitions and other row
    orders agree. Repeated rows are documents of their own; those with the same id and text stand side by side in the order.

    A null text has size 0 and is taken 0 times, as has an empty one. A null source is a source of its own. Empty tables give
    empty results. Other columns are not looked at.
    """
    slim = saved(_marked(docs, seed, id_col, source_col, text_col).select("__mix"))
    out = _repeated(slim, _facts(slim, cycle, max_epochs))
    size, repeats = F.col("__mix.size"), F.col("__repeats")
    return out.select(
        F.col("__mix.id").alias(id_col), size.alias("size"), F.col("__fact.source_size").alias("source_size"),
        F.col("__fact.target").alias("target"), repeats.alias("repeats"), (size * repeats).alias("taken"),
    )


def mixed(
    docs: DataFrame,
    cycle: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as ``mix_counts`` says. Texts are not shuffled, but for
    those of the edge slices."""
    rows = _marked(docs, seed, id_col, source_col, text_col)
    out = _repeated(rows, _facts(saved(rows.select("__mix")), cycle, max_epochs)).where(F.col("__repeats") > 0)
    out = out.select("__row", F.explode(F.sequence(F.lit(1), F.col("__repeats").cast("int"))))
    return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
