"""Document fingerprints: SimHash with weighted votes, and permuted block tables, by DataFrame functions alone."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import ref, saved

_SPLIT = r"[\x20\x09-\x0D]+"
#: A term weighs as much as it has characters, up to this: long terms are rarer and say more about a text.
HEAVIEST = 16
#: Stands for a null id, which so is the smallest.
NO_ID = -(1 << 63)
#: Two counters of 32 bits in a long: the votes for bits k and k + 32.
_LANES = (1 << 32) | 1
#: Fingerprints that share a block table entry and are compared with each other; larger groups are keyed by further blocks.
GROUP = 256


def weighted_terms(text: Column) -> Column:
    """The text's terms as an array of (h, w): the hash of each pair of neighbouring words (of the word, if there is but one) and
    its weight. Repeats stand as often as they occur."""
    words = F.filter(F.split(text, _SPLIT), lambda w: w != "")
    size = F.size(words)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(size - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(size - 1, F.lit(0))),
        lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), F.least(F.length(a) + F.length(b), F.lit(HEAVIEST)).alias("w")),
    )
    lone = F.transform(words, lambda a: F.struct(F.xxhash64(a).alias("h"), F.least(F.length(a), F.lit(HEAVIEST)).alias("w")))
    return F.when(size == 1, lone).otherwise(pairs)


def vote_sums() -> list[Column]:
    """Aggregates over exploded terms: the weight behind a set bit for bits k and k + 32 in one long, and the whole weight."""
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"v{k}") for k in range(32)]
    return [*lanes, F.sum(F.col("w").cast("long")).alias("total")]


def voted(total: Column) -> Column:
    """The fingerprint: a bit is 1 if terms that set it weigh more than those that do not."""

    def bit(k: int, votes: Column) -> Column:
        return F.when(votes * 2 > total, F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")

    bits = []
    for k in range(32):
        lane = F.col(f"v{k}")
        bits += [bit(k, lane.bitwiseAND(F.lit(0xFFFFFFFF))), bit(k + 32, F.shiftrightunsigned(lane, 32))]
    return F.coalesce(reduce(lambda a, b: a.bitwiseOR(b), bits), F.lit(0))


def hexed(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the share of differing bits stands for, 0 from a half on."""
    apart = F.bit_count(a.bitwiseXOR(b))
    return F.when(apart == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(apart / 64.0 * 3.141592653589793)))


def fingerprints(rows: DataFrame, text_col: str, keys: list[str], row: str) -> DataFrame:
    """``keys`` and ``fp`` for each row, told apart by the column ``row``: its terms vote where the row is, and a row of sums goes to the
    shuffle. Texts without terms have fingerprint 0."""
    terms = rows.select(row, *keys, F.inline_outer(weighted_terms(F.col(text_col))).alias("h", "w"))
    sums = terms.groupBy(row, *keys).agg(*vote_sums())
    return sums.select(row, *keys, voted(F.col("total")).alias("fp"))


def followers(docs: DataFrame) -> DataFrame:
    """For each distinct ``id`` the one before it (``prev``) and after it (``next``), ascending, null first; the ends meet. Ids are put
    in range partitions; a partition's ends come from a table with a row per partition."""
    order = F.col("id").asc_nulls_first()
    placed = saved(docs.select("id").distinct().repartitionByRange(order)).withColumn("part", F.spark_partition_id())
    placed = saved(placed)
    own = Window.partitionBy("part").orderBy(order)
    # Ids may be null, so that each stands in a struct of its own.
    cell = F.struct("id")
    ends = placed.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull(), F.col("id"))).alias("lo"), F.max(F.struct(F.col("id").isNotNull(), F.col("id"))).alias("hi"))
    parts = Window.orderBy("part")  # a row per partition
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        F.col("part").alias("e_part"),
        F.coalesce(F.lead("lo").over(parts), F.first("lo").over(whole)).alias("after"),
        F.coalesce(F.lag("hi").over(parts), F.last("hi").over(whole)).alias("ahead"),
    )
    rows = placed.select("id", "part", F.lead(cell).over(own).alias("n"), F.lag(cell).over(own).alias("p"))
    rows = rows.join(F.broadcast(ends), F.col("part") == F.col("e_part"))
    return rows.select(
        "id",
        F.when(F.col("n").isNull(), F.col("after.id")).otherwise(F.col("n.id")).alias("next"),
        F.when(F.col("p").isNull(), F.col("ahead.id")).otherwise(F.col("p.id")).alias("prev"),
    )


def _tables(blocks: list[tuple[int, int]], agree: int) -> list[int]:
    """Bit masks: each choice of ``agree`` blocks."""
    mask = [((1 << size) - 1) << start for start, size in blocks]
    return [sum(mask[i] for i in chosen) for chosen in combinations(range(len(blocks)), agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct longs in ``prints.fp`` that differ in 1 to ``radius`` bits, each once; all of them are found.

    64 bits are cut into ``blocks``. Whatever the differing bits, blocks - radius blocks agree, so there is a table for each choice
    of that many blocks, keyed by their bits: fingerprints with equal keys meet by an equality join, in which the distance
    is checked. A key with over ``GROUP`` fingerprints is not joined; its members are keyed by choices of the bits that the key
    leaves open as well, cut in the same way, and so on until keys are small. Few open bits make a group small, so this ends.
    """
    edges = [64 * k // blocks for k in range(blocks + 1)]
    todo = saved(prints.select("fp").distinct()).select("fp", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("trail"))
    levels: list[list[int]] = [_tables([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], blocks - radius)]
    found = None
    used_masks = [0]
    while True:
        rows = None
        for used in used_masks:
            free = [k for k in range(64) if not used >> k & 1]
            if used == 0:
                masks = levels[0]
            else:
                cuts = [free[len(free) * k // blocks : len(free) * (k + 1) // blocks] for k in range(blocks)]
                masks = [sum(1 << b for k in chosen for b in cuts[k]) for chosen in combinations(range(blocks), blocks - radius)]
            tables = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(m | used)).alias("now")) for m in masks])
            part = todo.where(F.col("used") == _signed(used)).select("fp", "trail", F.explode(tables).alias("t"))
            part = part.select("fp", F.col("t.now").alias("used"), F.xxhash64("trail", F.col("t.mask"), F.col("fp").bitwiseAND(F.col("t.mask"))).alias("key"))
            rows = part if rows is None else rows.unionAll(part)
        # One shuffle brings equal keys together; most stand alone and go no further.
        size = F.count(F.lit(1)).over(Window.partitionBy("key", "used"))
        met = saved(rows.withColumn("n", size).where("n > 1"))
        crowded = met.where(F.col("n") > GROUP)
        busy = [int(r[0]) & (1 << 64) - 1 for r in crowded.select("used").distinct().collect()]  # masks: a few at each level
        calm = met.where(F.col("n") <= GROUP)
        right = calm.select(F.col("key").alias("k2"), F.col("used").alias("u2"), F.col("fp").alias("b"))
        same = (F.col("key") == F.col("k2")) & (F.col("used") == F.col("u2"))
        near = same & (F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius)
        links = saved(calm.select("key", "used", "fp").join(right, near).select(F.col("fp").alias("a"), "b").distinct())
        found = links if found is None else found.unionAll(links)
        if not busy:
            return found.distinct()
        todo = crowded.select("fp", "used", F.col("key").alias("trail"))
        used_masks = busy


def document_fingerprints(
    docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per row of ``docs``: the id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (16 hex digits),
    near_edited and near_next (likeness, 0 to 1, of the fingerprint to that of the edited and of the next document's text), and n_near, how many
    other fingerprints of the table lie within ``radius`` bits.

    The next document has the next larger id; after the largest comes the smallest, and null counts as smallest. The edited text is the
    text with its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next document. Rows with one id are one
    place in the order: the next document of all of them is the row of the next id whose text has the smallest hash, or, if there is one id only, of
    their own. Null texts are empty; texts without words have fingerprint 0. Equal texts have equal fingerprints. Empty
    tables give an empty result, other columns are not looked at.

    Each text is shuffled once, by id; the part that goes to the document before travels without the rest.
    """
    source = docs.select(F.coalesce(ref(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(ref(text_col).cast("string"), F.lit("")).alias("text"))
    order = followers(source)
    lengths = source.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    order = order.join(lengths, "id")
    asked = order.select(F.col("id").alias("to"), F.floor(F.col("n") / 4).cast("int").alias("asked"))
    order = saved(order.join(asked, F.col("prev") == F.col("to")).select("id", "to", "asked"))
    # Both joins deal (id, text) by id, so that one shuffle of the texts serves both.
    heads = source.join(order, "id").select("to", F.left("text", F.col("asked")).alias("head"), F.xxhash64("text").alias("follower")).groupBy("to")
    heads = heads.agg(F.min(F.struct("follower", "head")).alias("h")).select("to", "h.head", "h.follower")
    pairs = source.join(heads, F.col("id") == F.col("to"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("head", cut))
    pairs = pairs.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), F.monotonically_increasing_id().alias("row"), n.cast("long").alias("n_chars"), "follower", "text", edited.alias("edited"))
    pairs = pairs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("own", F.xxhash64("text"))
    texts = F.explode(F.array(F.struct(F.lit(False).alias("e"), F.col("text").alias("t")), F.struct(F.lit(True).alias("e"), F.col("edited").alias("t")))).alias("x")
    both = pairs.select("row", "id", "n_chars", "follower", "own", "edited_sha256", texts)
    both = both.select("row", "id", "n_chars", "follower", "own", "edited_sha256", F.col("x.e").alias("e"), F.col("x.t").alias("t"))
    prints = fingerprints(both, "t", ["id", "n_chars", "follower", "own", "edited_sha256", "e"], "row")
    wide = saved(
        prints.groupBy("row", "id", "n_chars", "follower", "own", "edited_sha256").agg(
            F.max(F.when(~F.col("e"), F.col("fp"))).alias("fp"), F.max(F.when(F.col("e"), F.col("fp"))).alias("edited_fp")
        )
    )
    known = wide.groupBy(F.col("own").alias("next_text")).agg(F.min("fp").alias("next_fp"))
    links = near_links(wide, radius)
    counts = links.select(F.explode(F.array("a", "b")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n_near"))
    out = wide.join(known, F.col("follower") == F.col("next_text")).join(counts, F.col("fp") == F.col("f"), "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        hexed(F.col("fp")).alias("fingerprint"),
        hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
