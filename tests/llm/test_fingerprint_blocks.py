import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from llm import fingerprint_blocks
from llm.fingerprint_blocks import document_fingerprints, followers, near_links, weighted_terms
from tests.llm.helpers import AWKWARD, CLASHING, LONG, documents


def plain_print(spark, text):
    """Votes counted bit by bit from the terms."""
    terms = spark.createDataFrame([(text,)], "t string").select(weighted_terms(F.col("t")).alias("x")).first()["x"] or []
    bits = 0
    for b in range(64):
        votes = sum(t["w"] if t["h"] >> b & 1 else -t["w"] for t in terms)
        bits |= (votes > 0) << b
    return f"{bits:016x}"


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, clashing):
    docs = documents(spark)
    if clashing:
        docs = docs.selectExpr("*", *[f"'x' AS `{c}`" for c in [*CLASHING, "e", "t", "h", "w", "v0", "total", "next", "prev", "own", "edited", "follower"]])
    got = document_fingerprints(docs).collect()
    assert len(got) == len(AWKWARD)
    ids = sorted({i for i, _, _ in AWKWARD}, key=lambda i: (i is not None, i or 0))
    text = {i: t or "" for i, t, _ in AWKWARD}
    for r in got:
        own = text[r["doc_id"]]
        after = text[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(own) < 1000 and len(after) < 1000:
            assert r["fingerprint"] == plain_print(spark, own) and r["edited_fingerprint"] == plain_print(spark, edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = {r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 5)}
    assert same == {"0" * 16}


def brute_print(text):
    """Hashes, weights and votes without Spark: XXH64 of the second word, seeded by that of the first."""
    words = re.split(r"[\x20\x09-\x0D]+", text)
    words = [w for w in words if w]
    digest = lambda w, seed: xxhash.xxh64_intdigest(w.encode(), seed)
    terms = [(digest(b, digest(a, 42)), min(16, len(a) + len(b))) for a, b in zip(words, words[1:])]
    if len(words) == 1:
        terms = [(digest(words[0], 42), min(16, len(words[0])))]
    total = sum(w for _, w in terms)
    return sum(1 << bit for bit in range(64) if 2 * sum(w for h, w in terms if h >> bit & 1) > total)


def check_against_brute_force(docs):
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(rows)
    prints = {i: brute_print(rows[i]) for i in ids}
    distinct = set(prints.values())
    likeness = lambda a, b: max(0.0, math.cos((a ^ b).bit_count() / 64 * math.pi))
    got = {r["doc_id"]: r for r in document_fingerprints(docs).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        own, after = rows[i], ids[(k + 1) % len(ids)]
        cut = len(own) // 4
        edited = brute_print(own[: len(own) - cut] + rows[after][:cut])
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{prints[i]:016x}", f"{edited:016x}")
        assert r["near_edited"] == pytest.approx(likeness(prints[i], edited)) and r["near_next"] == pytest.approx(likeness(prints[i], prints[after]))
        assert r["n_near"] == sum(1 for other in distinct if 0 < (other ^ prints[i]).bit_count() <= 3)


def test_given_table_equals_brute_force(spark):
    check_against_brute_force(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_near_copies_and_long_texts_equal_brute_force(spark):
    draw = random.Random(12)
    base = " ".join(draw.choice("abcdefgh") * draw.randint(1, 6) for _ in range(3000))
    rows = [(i, base.replace(" ", "  ", i) + f" tail{i // 2}" * (i % 3), "s") for i in range(20)] + [(50, LONG, "s"), (51, LONG + "x", "s"), (60, "one", "s")]
    check_against_brute_force(documents(spark, rows))


def test_likeness_tells_an_edit_from_another_text(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(200)), "s") for i in range(60)] + [(100, "same text here", "s"), (101, "same text here", "s")]
    got = document_fingerprints(documents(spark, rows)).collect()
    assert all(r["near_edited"] > r["near_next"] + 0.15 for r in got if r["doc_id"] < 60)
    twins = [r for r in got if r["doc_id"] >= 100]
    assert twins[0]["fingerprint"] == twins[1]["fingerprint"] and twins[0]["doc_id"] is not None


def test_empty_and_single(spark):
    assert document_fingerprints(documents(spark, [])).count() == 0
    got = document_fingerprints(documents(spark, [(None, "abcdefgh ij", None)])).first()
    assert got["edited_sha256"] == hashlib.sha256(("abcdefgh ij"[:9] + "ab").encode()).hexdigest() and got["near_next"] == 1.0


def test_followers_across_partitions(spark):
    ids = [None, *random.Random(1).sample(range(-1000, 1000), 300)]
    got = followers(spark.createDataFrame([(i,) for i in ids] * 2, "id bigint").repartition(5)).collect()
    order = sorted(set(ids), key=lambda i: (i is not None, i or 0))
    want = {i: (order[k - 1], order[(k + 1) % len(order)]) for k, i in enumerate(order)}
    assert {r["id"]: (r["prev"], r["next"]) for r in got} == want and len(got) == len(order)


@pytest.mark.parametrize("group", [256, 6])
def test_block_tables_find_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(fingerprint_blocks, "GROUP", group)
    draw, values = random.Random(6), {0, -1, 1, -(1 << 63)}
    for _ in range(8):
        seed = draw.getrandbits(64)
        for _ in range(14):
            value = seed
            for bit in draw.sample(range(64), draw.randint(0, 4)):
                value ^= 1 << bit
            values.add(value - (1 << 64) if value >> 63 else value)
    got = near_links(spark.createDataFrame([(v,) for v in values], "fp bigint"), 3).collect()
    mask = (1 << 64) - 1
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
