import re

import pytest
from pyspark.sql import functions as F

from llm.mixing import mix_counts, mixed, water_fill
from tests.llm.helpers import AWKWARD, documents


def plain_targets(sizes, weights, limit=3.0):
    open_, target = dict(zip(range(len(sizes)), weights, strict=True)), [0.0] * len(sizes)
    left = float(sum(sizes))
    while open_:
        level = left / sum(open_.values())
        full = [k for k, w in open_.items() if sizes[k] * limit <= w * level]
        if not full:
            for k, w in open_.items():
                target[k] = w * level
            break
        for k in full:
            target[k] = sizes[k] * limit
            left -= target[k]
            del open_[k]
    return target


def by_source(rows):
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {n: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, s in rows if s == n) for n in names}
    return names, size, dict(zip(names, plain_targets([size[n] for n in names], [1 + k % 3 for k in range(len(names))]), strict=True))


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, clashing):
    got = mix_counts(documents(spark, clashing=clashing)).collect()
    names, size, target = by_source(AWKWARD)
    assert len(got) == len(AWKWARD)
    of = {i: s for i, _, s in AWKWARD}
    for r in got:
        assert r["source_size"] == size[of[r["doc_id"]]] and r["target"] == pytest.approx(target[of[r["doc_id"]]])
        assert r["taken"] == r["repeats"] * r["size"] <= 3 * r["size"]


def test_taken_words_come_within_a_document_of_the_target(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 11 if i % 3 else 0:02d}") for i in range(3000)]
    got = mix_counts(documents(spark, rows)).collect()
    names, size, target = by_source(rows)
    of = {i: s for i, _, s in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        taken[of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[n] - target[n]) <= 23 for n in names)
    again = mix_counts(documents(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_limits_cascade(spark):
    sizes, weights = [1000, 5, 10, 400, 0], [1.0, 9.0, 5.0, 1.0, 2.0]
    df = spark.createDataFrame([(k, s, w) for k, (s, w) in enumerate(zip(sizes, weights, strict=True))], "k int, size bigint, weight double")
    got = [r["target"] for r in water_fill(df, 3.0).orderBy("k").collect()]
    assert got == pytest.approx(plain_targets(sizes, weights)) and sum(got) == pytest.approx(sum(sizes))


def test_mix_repeats_whole_rows(spark):
    docs = documents(spark, clashing=True)
    got = mixed(docs)
    assert got.columns == docs.columns
    want = {r["doc_id"]: 0 for r in docs.collect()}
    for r in mix_counts(docs).collect():
        want[r["doc_id"]] += r["repeats"]
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in want.items() if v}


def test_empty_and_wordless_tables(spark):
    assert mix_counts(documents(spark, [])).count() == 0 and mixed(documents(spark, [])).count() == 0
    got = mix_counts(documents(spark, [(1, "", "a"), (2, None, None)]))
    assert [(r["taken"], r["target"]) for r in got.collect()] == [(0, 0.0)] * 2
    assert got.where(F.col("repeats") > 0).count() == 0
