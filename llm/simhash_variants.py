"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ref, saved, text_bytes
from llm.components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are unpacked at once.
_AT_ONCE = 1 << 16
#: Fingerprints of one signature that are compared with each other; larger groups are cut by further segments.
GROUP = 1024


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 values of the text's shingles, repeats included. ``bytes.split`` cuts at the six
    ASCII white-space characters, so the words are runs of anything else. No words: 0."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    total = max(1, len(parts) - words + 1)
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, total, _AT_ONCE):
        some = [parts[start + k : start + k + min(_AT_ONCE, total - start)] for k in range(words)]
        shingles = zip(*some, strict=False) if len(parts) >= words else [tuple(parts)]
        hashes = np.array([digest(b" ".join(s), seed) for s in shingles], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """The fingerprint of a text column as a long (the same 64 bits, signed)."""

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch), dtype=np.uint64, count=len(batch))
            yield pa.array(found.view(np.int64))

    make.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(make, "bigint")(text_bytes(text))


def _segments(free: tuple[int, ...], count: int) -> list[tuple[int, ...]]:
    """The free bits cut into ``count`` runs of nearly equal length."""
    size = len(free)
    return [free[size * k // count : size * (k + 1) // count] for k in range(count)]


def _variants(level: int, radius: int):
    """mapInArrow: signatures of fingerprints. At level 0 all 64 bits are cut into radius // 2 + 1 segments, of which one differs by
    at most one bit, and a row for each segment and each place in it holds the segment without that bit. At higher levels
    the bits outside the segments of the group so far are cut again; ``key`` is then a hash of all signatures."""
    count = radius // 2 + 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            trail = batch["trail"].to_numpy(zero_copy_only=False).view(np.uint64) if level else np.zeros(len(value), np.uint64)
            spent = batch["spent"].to_numpy(zero_copy_only=False).view(np.uint64) if level else np.zeros(len(value), np.uint64)
            for used in np.unique(spent):
                rows = np.flatnonzero(spent == used)
                free = tuple(b for b in range(64) if not int(used) >> b & 1)
                for number, bits in enumerate(_segments(free, count)):
                    mask = np.uint64(sum(1 << b for b in bits))
                    for gone in bits:
                        rest = value[rows] & mask & ~np.uint64(1 << gone)
                        key = _mixed(rest, number << 6 | gone, trail[rows])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(key.view(np.int64)),
                                pa.array(value[rows].view(np.int64)),
                                pa.array(np.full(len(rows), mask & ~np.uint64(1 << gone) | used).view(np.int64)),
                            ],
                            ["key", "fp", "spent"],
                        )

    return make


def _mixed(rest: np.ndarray, tag: int, trail: np.ndarray) -> np.ndarray:
    """A 64-bit mix of signature, place and earlier signatures. Two signatures that meet by chance cost a comparison; no link
    can be lost, as equal signatures give equal values."""
    place = np.uint64((tag + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
    h = rest * np.uint64(0x9E3779B97F4A7C15) + place + trail
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _verified(radius: int):
    """mapInArrow over rows sorted by key: links between the fingerprints of a key at most ``radius`` bits apart, once in each run,
    and the rows of keys with over GROUP fingerprints, for the next level."""

    def pairs(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        here = np.arange(len(key))
        step = 1
        while len(here):
            here = here[here + step < len(key)]
            here = here[key[here] == key[here + step]]
            near = np.bitwise_count(value[here] ^ value[here + step]) <= radius
            left.append(value[here[near]])
            right.append(value[here[near] + step])
            step += 1
        return (np.concatenate(left), np.concatenate(right)) if left else (value[:0], value[:0])

    def rows(a, b, trail, spent) -> pa.RecordBatch:
        columns = [a.view(np.int64), b.view(np.int64), trail.view(np.int64), spent.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "trail", "spent"])

    def divisible(spent: np.ndarray) -> np.ndarray:
        """Enough open bits that each further segment keeps one after a deletion; fewer bits tell few fingerprints apart."""
        return 64 - np.bitwise_count(spent).astype(int) >= 2 * (radius // 2 + 1)

    def closed(key, value, spent) -> Iterator[pa.RecordBatch]:
        """The runs of equal keys in these rows are whole."""
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        crowded = np.repeat(size > GROUP, size) & divisible(spent)
        if crowded.any():
            yield rows(value[crowded], value[crowded], key[crowded], spent[crowded])
        small = ~crowded
        a, b = pairs(key[small], value[small])
        if len(a):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            zero = np.zeros(both.shape[1], np.uint64)
            yield rows(both[0][both[0] != both[1]], both[1][both[0] != both[1]], zero[both[0] != both[1]], zero[both[0] != both[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        hot: np.uint64 | None = None  # a run too long to hold: its rows are passed on as they come
        for batch in batches:
            new = [batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp", "spent")]
            now = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(now[0]):
                continue
            if hot is not None:
                same = now[0] == hot
                if same.any():
                    yield rows(now[1][same], now[1][same], now[0][same], now[2][same])
                    now = [x[~same] for x in now]
                    if not len(now[0]):
                        held = None
                        continue
                hot = None
            open_from = len(now[0]) - int(np.count_nonzero(now[0] == now[0][-1]))
            done, held = [x[:open_from] for x in now], [x[open_from:] for x in now]
            if len(done[0]):
                yield from closed(*done)
            if len(held[0]) > GROUP and divisible(held[2][:1])[0]:
                hot = held[0][0]
                yield rows(held[1], held[1], held[0], held[2])
                held = None
        if held is not None and len(held[0]):
            yield from closed(*held)

    return run


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs ``a``, ``b`` of the distinct longs in ``prints.fp`` that differ in 1 to ``radius`` bits, each once.

    All pairs are found: of radius // 2 + 1 segments one differs by at most one bit, so two such fingerprints share a
    signature that leaves this bit out. Signatures meet in one shuffle and are compared in sorted order, batch by batch. A
    signature with over ``GROUP`` fingerprints is not compared but cut again: its members get signatures of the remaining
    bits under the same rule, which can differ in no more bits than the whole, until groups are small. Each level
    settles nearly half of the bits that are left, so this ends after a few levels.
    """
    level, todo, found = 0, prints.select("fp").distinct(), None
    while True:
        keys = todo.mapInArrow(_variants(level, radius), "key bigint, fp bigint, spent bigint")
        met = keys.repartition("key").sortWithinPartitions("key", "fp")
        out = saved(met.mapInArrow(_verified(radius), "a bigint, b bigint, trail bigint, spent bigint"))
        links = out.where("a != b").select("a", "b")
        found = links if found is None else found.unionAll(links)
        todo = out.where("a = b").select(F.col("a").alias("fp"), "trail", "spent")
        level += 1
        if todo.isEmpty():
            return found.distinct()


def near_duplicates(
    docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per row of ``docs``: the id, ``fingerprint`` (16 lower-case hex digits) and ``component_id``, the smallest id reachable over
    links between fingerprints that differ in at most ``radius`` bits (equal ones included).

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of ``words`` words; repeats count, and a
    text with fewer words is one shingle. Texts without words, null and empty ones, have fingerprint 0 and link like any other.
    Copies are one fingerprint, however many: only the smallest id of each goes on. Rows with a null id count as texts but
    never give a component its id; a component of such rows only has id null. Repeated rows stay repeated.
    """
    rows = saved(docs.select(ref(id_col).cast("long").alias("id"), fingerprints(ref(text_col).cast("string"), words).alias("fp")))
    prints = saved(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(prints, radius))
    joined = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = saved(joined)
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(names, "root").select(F.col("fp").alias("f"), "component_id")
    out = rows.join(named, F.col("fp") == F.col("f"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
