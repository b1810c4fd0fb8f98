import random
import re

import pytest
from pyspark.sql import functions as F

from llm.license_join import NOTICES, PHRASES, license_matches, license_scan, templates

from .helpers import AWKWARD, LONG, SCHEMA, documents, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, phrases=PHRASES, notices=NOTICES, threshold=0.8):
    """Every block of every length against every template."""
    w = words(text)
    base, spots, labels, score = set(), [], set(), 0.0
    for phrase, label in phrases:
        p = words(phrase)
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        spots += at
        if at:
            base.add(label)
            score = 1.0
    for notice, label in notices:
        t = words(notice)
        step = 4
        while step < len(t):
            step *= 2
        need = threshold if len(set(t)) >= 10 else 1.0
        for start in range(0, len(w), step):
            share = len(set(t) & set(w[start : start + 2 * step])) / len(set(t))
            if share >= need - 1e-12:
                labels.add(label)
                score = max(score, share)
    ends = (min(spots), max(spots)) if spots else (None, None)
    return len(w), len(spots), *ends, ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def planted(seed):
    """Notices with some words dropped or changed, at any place between other words, some of them common in notices."""
    rng = random.Random(seed)
    filler = ["the", "of", "und", "license", "software", "xyz", "é", "public", "mit", "apache", "general"]
    out = []
    for k in range(60):
        text = [rng.choice(filler) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice([*NOTICES, *PHRASES])[0].split()
            t = [w if rng.random() > rng.choice([0.0, 0.1, 0.25]) else rng.choice(["", "other"]) for w in t]
            at = rng.randint(0, len(text))
            text[at:at] = t
        out.append((k, rng.choice([" ", "\n", "--"]).join(text), "s"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_blocks_against_all_templates(spark, seed):
    rows = planted(seed)
    want = sorted(((k, *plain(text)) for k, text, _ in rows), key=repr)
    assert found(license_scan(table(spark, rows, SCHEMA).repartition(4))) == want
    assert {w[6] for w in want} > {"", "mit"}


def test_awkward_rows(spark):
    more = [(20, LONG + "MIT License " + LONG, "s"), (None, "the Apache\tLICENSE, mit-license", None), (20, "Licensed under CC BY-NC 4.0.", "s")]
    want = sorted(((k, *plain(text)) for k, text, _ in AWKWARD + more), key=repr)
    df = documents(spark, AWKWARD + more, clashing=True).withColumns({c: F.lit("x") for c in ["uid", "uidw", "words", "start", "label"]})
    assert found(license_scan(df)) == want


def test_matches_name_blocks(spark):
    rows = [(1, "x " * 37 + NOTICES[1][0], "s"), (2, "nothing", "s"), (3, "a mit license and a mit license", "s")]
    got = [r.asDict() for r in license_matches(table(spark, rows, SCHEMA)).collect()]
    isc = [r for r in got if r["doc_id"] == 1]
    assert {(r["label"], r["containment"], r["words"]) for r in isc} == {("isc", 1.0, 128)}
    assert any(r["start"] <= 37 and r["start"] + 128 >= 37 + len(words(NOTICES[1][0])) for r in isc)
    assert sorted(p for r in got if r["doc_id"] == 3 for p in r["places"]) == [1, 5]
    assert not [r for r in got if r["doc_id"] == 2]


def test_own_templates_and_threshold(spark):
    own = [("one two three four five six seven eight nine ten", "ten")]
    rows = [(k, " ".join(own[0][0].split()[:k]), "s") for k in range(11)]
    got = {r["doc_id"]: r["labels"] for r in license_scan(table(spark, rows, SCHEMA), phrases=[], notices=own, threshold=0.7).collect()}
    assert got == {k: "ten" if k >= 7 else "" for k in range(11)}


def test_empty(spark):
    out = license_scan(documents(spark, []))
    assert out.collect() == [] and out.columns == COLUMNS


def test_template_lengths():
    assert [t.step for t in templates(PHRASES, [], 0.8)] == [4, 4, 4]
    assert all(t.step >= len(t.words) for t in templates(PHRASES, NOTICES, 0.8))
