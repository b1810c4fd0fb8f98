import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm.prefix_trie import _end_digests, ordered, prefix_trie, running

from .helpers import CLASHING, LONG, table

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, most=5):
    """Every prefix of every rebuilt conversation, one by one."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    turns = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = turns.get(c - c % 100 if c >= 0 else c + -c % 100, [])
        whole[c] = tuple(base[:h] + mine[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = []
    for node, ids in members.items():
        under = [n for n in members if n[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in ids if len(whole[c]) == len(node))))
        out.append(
            (
                min(ids),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(ids),
                len(kids.get(node, [])),
                sum(n not in kids for n in under),
                sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made(seed, ids, longest=9, words=2):
    rng = random.Random(seed)
    return [
        (c, t if t else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["a", "bb", "é\U0001f642", "", None][: words + 1]))
        for c in ids
        for t in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize(
    "ids",
    [
        [*range(0, 60), *range(100, 130), *range(205, 240)],  # conversation 200 does not exist
        [*range(-150, -60), *range(0, 5)],
        [7],
        [10**12, 10**12 + 100, 10**12 + 101],
    ],
)
def test_equals_plain_trie(spark, ids):
    rows = made(len(ids), ids)
    df = table(spark, rows, SCHEMA).repartition(5)
    assert found(prefix_trie(df)) == plain(rows)


def test_identical_conversations_and_null_ids(spark):
    rows = [(c, t, "user", "same") for c in range(300, 400) for t in range(4)] + [(None, 1, "user", "x"), (301, None, None, None)]
    assert found(prefix_trie(table(spark, rows, SCHEMA))) == plain(rows)


def test_clashing_columns_and_long_texts(spark):
    rows = [(c, t, "user", LONG if t == 1 else "x") for c in (0, 1, 2) for t in range(7)]
    df = table(spark, rows, SCHEMA).withColumns({c: F.lit("x") for c in [*CLASHING, "depth", "k1", "c", "chars"]})
    assert found(prefix_trie(df)) == plain(rows)


def test_repeated_turn_numbers_give_one_order(spark):
    rows = [(c, 3, "user", f"text {k % 3}") for c in (0, 1) for k in range(8)]
    first, second = (found(prefix_trie(table(spark, rows[::step], SCHEMA).repartition(n))) for step, n in ((1, 1), (-1, 4)))
    assert first == second
    assert max(r[1] for r in first) == 8


def test_empty(spark):
    out = prefix_trie(table(spark, [], SCHEMA))
    assert out.collect() == [] and out.columns == COLUMNS


def test_running_over_groups_that_span_partitions(spark):
    rng = random.Random(8)
    groups = [1] * 3 + [2] * 500 + [3] + [4] * 40 + [9] * 200
    rows = [(g, i, rng.randint(-(1 << 62), 1 << 62)) for i, g in enumerate(groups)]
    total, place, want = 0, 0, {}
    for k, (g, i, v) in enumerate(rows):
        if not k or g != rows[k - 1][0]:
            total = place = 0
        before, total, place = total, total + v, place + 1
        want[i] = (place, *((x + (1 << 63)) % (1 << 64) - (1 << 63) for x in (total, before)))
    small = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        df = ordered(table(spark, rows[::-1], "c bigint, i bigint, v bigint").repartition(7), F.col("c"), F.col("i"))
        assert df.rdd.getNumPartitions() == 4
        got = {r["i"]: (r["n"], r["v"], r["before_v"]) for r in running(df, "c", ["v"], "n").collect()}
    finally:
        for key in small:
            spark.conf.unset(key)
    assert got == want


def test_end_digest_of_a_large_group(spark):
    df = spark.range(0, 5000, numPartitions=6).selectExpr("id * 3 - 4000 as c", "if(id = 17, 2L, 1L) as depth", "0L as k1", "0L as k2")
    got = {r["depth"]: r["ends_sha256"] for r in _end_digests(df).collect()}
    ids = [i * 3 - 4000 for i in range(5000)]
    want = {1: [c for i, c in enumerate(ids) if i != 17], 2: [ids[17]]}
    assert got == {d: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for d, c in want.items()}
