import random

import numpy as np
import pytest
import xxhash

from llm import simhash_variants
from llm.simhash_variants import fingerprint, near_duplicates, near_links
from tests.llm.helpers import AWKWARD, documents


def plain_fingerprint(text, words=3):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [p for p in __import__("re").split(r"[\x20\x09-\x0D]+", parts) if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_links(values, radius):
    values = sorted({int(v) for v in values})
    return {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= radius}


def plain_components(ids, prints, radius):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in plain_links(set(prints), radius):
        root[find(a)] = find(b)
    names = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            names[find(p)] = min(names.get(find(p), i), i)
    return [names.get(find(p)) for p in prints]


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, clashing):
    got = near_duplicates(documents(spark, clashing=clashing)).collect()
    ids, prints = [r[0] for r in AWKWARD], [plain_fingerprint(r[1]) for r in AWKWARD]
    want = zip(ids, [f"{p:016x}" for p in prints], plain_components(ids, prints, 2), strict=True)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0


def test_fingerprint_of_many_shingles_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(simhash_variants, "_AT_ONCE", 7)
    draw = random.Random(1)
    for n in (1, 2, 3, 4, 9, 50):
        text = " ".join(draw.choice("abcdefg") for _ in range(n))
        assert fingerprint(text.encode(), 3) == plain_fingerprint(text)


@pytest.mark.parametrize(("radius", "group"), [(2, 1024), (2, 16), (3, 16), (5, 16)])
def test_links_are_all_pairs_within_the_radius(spark, monkeypatch, radius, group):
    """A small ``group`` sends nearly all through the further levels."""
    monkeypatch.setattr(simhash_variants, "GROUP", group)
    draw = random.Random(radius)
    values = set()
    for _ in range(12):
        seed = draw.getrandbits(64)
        values.add(seed)
        for _ in range(25):
            value = seed
            for bit in draw.sample(range(64), draw.randint(1, radius + 1)):
                value ^= 1 << bit
            values.add(value)
    values |= {0, 1, (1 << 64) - 1, (1 << 64) - 2, 1 << 63}
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    got = near_links(spark.createDataFrame(signed, "fp bigint"), radius).collect()
    mask = (1 << 64) - 1
    pairs = [tuple(sorted((r["a"] & mask, r["b"] & mask))) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_links(values, radius)


def test_chains_reach_the_smallest_id(spark):
    draw = random.Random(4)
    bits = draw.sample(range(64), 40)
    value, chain = draw.getrandbits(64), []
    for k in range(20):
        chain.append(value)
        value ^= 1 << bits[2 * k] | 1 << bits[2 * k + 1]
    from llm.components import components

    edges = spark.createDataFrame([(a if a < 1 << 63 else a - (1 << 64), b if b < 1 << 63 else b - (1 << 64)) for a, b in zip(chain, chain[1:])] + [(None, 5)], "a bigint, b bigint")
    got = components(edges).collect()
    assert len(got) == 20 and len({r["root"] for r in got}) == 1 and got[0]["root"] == min(r["node"] for r in got)
