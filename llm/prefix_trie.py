"""The prefix trie of conversations by collapsing whole sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ref, saved

#: Ids that travel to a digest in one row.
_AT_ONCE = 512
_KEY = ["depth", "k1", "k2"]


def ordered(rows: DataFrame, *keys: Column) -> DataFrame:
    """Saved rows in the order of ``keys`` across and within partitions. Equal keys, however many, may lie in several partitions."""
    keys = (*keys, F.col("__scan"))
    placed = rows.withColumn("__scan", F.monotonically_increasing_id()).repartitionByRange(*keys)
    return saved(placed.sortWithinPartitions(*keys).drop("__scan"))


def running(rows: DataFrame, group: str, values: list[str], place: str) -> DataFrame:
    """Adds ``place``, the number of the row in its ``group`` from 1, turns ``values`` (longs, wrapping) into sums up to the row, and adds
    ``before_`` columns with the sums up to the row before.

    ``rows`` is in order of the group, a long. A group may span any number of partitions: each sends what its last group comes to,
    a row a partition, and gets what the partitions before it hold of its first group.
    """
    rows = rows.withColumn("__part", F.spark_partition_id())

    def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch[name].to_numpy(zero_copy_only=False)

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        whole, sums = True, np.zeros(len(values) + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = longs(batch, group)
            if part is None:
                part, first = batch["__part"][0].as_py(), c[0]
            apart = np.flatnonzero(c != c[-1])
            start = apart[-1] + 1 if len(apart) else 0
            if last is not None and (start or c[0] != last):
                whole = False
            if start:
                whole = False
            if start or c[0] != last:
                sums = np.zeros_like(sums)
            last = c[-1]
            sums = sums + np.array([len(c) - start, *[longs(batch, v)[start:].sum() for v in values]], dtype=np.int64)
        if part is not None:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "first": [int(first)], "last": [int(last)], "whole": [whole], "sums": [sums.tolist()]}
            )

    shape = "part int, first bigint, last bigint, whole boolean, sums array<bigint>"
    carry, group_now, held = {}, None, np.zeros(len(values) + 1, np.int64)
    for r in sorted(rows.select("__part", group, *values).mapInArrow(tail, shape).collect(), key=lambda r: r["part"]):
        same = r["first"] == group_now
        if same:
            carry[r["part"]] = held
        held = np.array(r["sums"], np.int64) + (held if same and r["whole"] else 0)
        group_now = r["last"]

    def sums_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(len(values) + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = longs(batch, group)
            if last is None:
                last, held = c[0], carry.get(batch["__part"][0].as_py(), held)
            here = np.arange(len(c))
            new = np.r_[c[0] != last, c[1:] != c[:-1]]
            start = np.maximum.accumulate(np.where(new, here, 0))
            goes_on = (np.cumsum(new) == 0).astype(np.int64)
            added = [np.ones(len(c), np.int64), *[longs(batch, v) for v in values]]
            out = [(t := np.cumsum(v)) - (t - v)[start] + goes_on * held[k] for k, v in enumerate(added)]
            last, held = c[-1], np.array([o[-1] for o in out])
            columns = {n: batch[n] for n in batch.schema.names if n != "__part" and n not in values} | {place: pa.array(out[0])}
            for name, total, v in zip(values, out[1:], added[1:], strict=True):
                columns |= {name: pa.array(total), "before_" + name: pa.array(total - v)}
            yield pa.RecordBatch.from_pydict(columns)

    kept = [f for f in rows.schema if f.name != "__part" and f.name not in values]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{place} bigint"]
    fields += [f"{before}{v} bigint" for v in values for before in ("", "before_")]
    return rows.mapInArrow(sums_up, ", ".join(fields))


def rebuilt(turns: DataFrame, most: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All conversation ids (``c``), and the turns of the rebuilt conversations in order: ``c``, ``depth`` from 1, two 64-bit hashes ``a``, ``b`` of
    role and text, ``chars``. Only these travel; texts are read once, where they are."""
    role, text = (F.coalesce(ref(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    narrow = turns.select(
        ref(conv_col).cast("long").alias("c"),
        ref(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), role, text).alias("b"),
        F.char_length(text).cast("long").alias("chars"),
    ).where(F.col("c").isNotNull())
    own = running(ordered(narrow, F.col("c"), F.asc_nulls_first("turn"), F.col("a"), F.col("b")).drop("turn"), "c", [], "turn")
    shared = (F.crc32(F.col("c").cast("string")) % (most + 1)).alias("shared")
    convs = saved(own.groupBy("c").agg(F.max("turn").alias("turns")))
    base = F.col("c") - F.col("c") % 100
    heads = own.where((F.col("c") % 100 == 0) & (F.col("turn") <= most)).select(F.col("c").alias("base"), "turn", "a", "b", "chars")
    lent = convs.select("c", base.alias("base"), shared).where("shared > 0").join(heads, "base").where("turn <= shared")
    kept = own.select("*", shared).where("turn > shared")
    both = lent.select("c", F.lit(0).alias("own"), "turn", "a", "b", "chars").unionAll(kept.select("c", F.lit(1).alias("own"), "turn", "a", "b", "chars"))
    placed = ordered(both, F.col("c"), F.col("own"), F.col("turn")).drop("own", "turn")
    return convs.select("c"), running(placed, "c", [], "depth")


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids ``c`` of each key, ascending and joined by commas. Ids are sorted over all tasks and joined to short strings where they
    lie; one pass over the strings of a key then feeds its digest, which is sequential by nature, without holding them."""

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch[k].to_numpy(zero_copy_only=False) for k in _KEY])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = keys(batch)
            new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]
            here = np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(new, here, 0))
            start = np.flatnonzero((here - begin) % _AT_ONCE == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[start, batch.num_rows], pa.int32()), pc.cast(batch["c"], pa.string()))
            taken = batch.take(pa.array(start))
            yield pa.RecordBatch.from_arrays([*[taken[k] for k in _KEY], taken["c"], pc.binary_join(lists, ",")], [*_KEY, "c", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def row(found: list) -> pa.RecordBatch:
            named = [pa.array([f[0][0] for f in found], pa.int64()), *[pa.array([f[0][k] for f in found], pa.int64()) for k in (1, 2)]]
            return pa.RecordBatch.from_arrays([*named, pa.array([f[1] for f in found], pa.string())], [*_KEY, "ends_sha256"])

        for batch in batches:
            done = []
            for key, ids in zip(keys(batch).T.tolist(), batch["ids"].to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield row(done)
        if last is not None:
            yield row([(last, state.hexdigest())])

    listed = ordered(ends.select(*_KEY, "c"), *[F.col(k) for k in (*_KEY, "c")])
    short = listed.mapInArrow(join, "depth bigint, k1 bigint, k2 bigint, c bigint, ids string")
    met = short.repartition(*_KEY).sortWithinPartitions(*_KEY, "c")
    return met.mapInArrow(digest, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, most: int = 5, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Conversation c is rebuilt as the first h turns of conversation c - c % 100, all if it has fewer, none if it does not
    exist, followed by its own turns after the first h; h is crc32 of the decimal c modulo ``most`` + 1. A node is a distinct sequence of first
    turns, equal in role and text; the root has none. ``saved_tokens`` adds up (n_convs - 1) x code points of the last text over the
    subtree; ``ends_sha256`` is the digest of the ascending ids that end at the node, joined by commas.

    The method: equal rebuilt conversations collapse into one weighted sequence with its list of ends, known by the running
    sum of hashes of place and turn (two of 64 bits), which also names every prefix. Sequences that are the parent of some prefix go by an
    anti-join; the rest are leaves. Prefixes of the weighted sequences then add up. The smallest member of a node owns it, and the
    nodes that a sequence owns are the lower end of its path: so the savings below a node are the savings owned by all sequences through it, less
    those that its owner has above it.

    No conversation, node or end list is gathered, and partial sums come before every shuffle: a conversation with a third of all
    turns, or a turn that a third of all conversations share, is many short rows, cut by order or by adaptive execution.

    Null turns come first. Turns with one number are in the order of their hashes: the same on every run and layout. Repeated
    rows are repeated turns. Null roles and texts are empty; rows without a conversation id are left out. An id whose rebuilt
    conversation has no turns is a member of the root. An empty table has no nodes. Other columns are not looked at.
    """
    convs, steps = rebuilt(turns, most, conv_col, turn_col, role_col, text_col)
    hashed = steps.select("c", "depth", "chars", F.xxhash64("depth", "a", "b").alias("k1"), F.xxhash64("b", "depth", "a").alias("k2"))
    paths = saved(running(hashed, "c", ["k1", "k2"], "__place").drop("__place").withColumnsRenamed({"before_k1": "p1", "before_k2": "p2"}))

    last = paths.groupBy("c").agg(F.max(F.struct("depth", "k1", "k2")).alias("last"))
    at_end = [F.coalesce(F.col("last")[k], F.lit(0).cast("long")).alias(k) for k in _KEY]
    ends = saved(convs.join(last, "c", "left").select("c", *at_end))
    whole = saved(ends.groupBy(*_KEY).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("weight")))
    parents = paths.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).distinct()
    leaves = whole.join(parents, _KEY, "left_anti").select("c", F.lit(1).alias("leaf"))
    weighted = saved(whole.join(leaves, "c", "left").select("c", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf")))

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    steps_of = paths.join(weighted, "c").select("c", *_KEY, "p1", "p2", "chars", "weight", "leaf")
    roots = weighted.select("c", *[zero.alias(k) for k in _KEY], none.alias("p1"), none.alias("p2"), zero.alias("chars"), "weight", "leaf")
    prefixes = saved(steps_of.unionAll(roots))
    sums = [F.min("c").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves")]
    found = prefixes.groupBy(*_KEY).agg(*sums, *[F.min(x).alias(x) for x in ("p1", "p2", "chars")])
    gains = found.withColumn("gain", (F.col("n_convs") - 1) * F.col("chars")).drop("chars")
    by_owner = ordered(gains, F.col("conv_id"), F.col("depth"))
    nodes = saved(running(by_owner, "conv_id", ["gain"], "__place").drop("__place"))

    owned = saved(nodes.groupBy(F.col("conv_id").alias("c")).agg(F.max("gain").alias("owned")).where("owned > 0"))
    through = prefixes.select("c", *_KEY).join(owned, "c").groupBy(*_KEY).agg(F.sum("owned").alias("through"))
    under = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*under).agg(F.count(F.lit(1)).alias("n_children"))
    above = saved(nodes.select(F.col("depth").alias("d"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id")))
    known = saved(nodes.join(children, _KEY, "left").join(through, _KEY, "left").join(_end_digests(ends), _KEY, "left"))
    out = known.join(above, (F.col("depth") - 1 == F.col("d")) & (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")), "left")
    return out.select(
        F.col("conv_id").alias(conv_col),
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        (F.coalesce("through", zero) - F.col("before_gain")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
