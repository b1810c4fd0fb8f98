import random
import zlib

import numpy as np
import pytest

from llm.toxicity import _matrix, terms, toxicity, train_nnpu, without_toxic
from tests.llm.helpers import AWKWARD, CLASHING, documents, table

LABELS = "doc_id bigint, quality int, toxic int"
BAD = ["stupid", "moron", "scum", "loser", "trash"]


def corpus(n=1500, seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7))) for _ in range(2000)]
    rows, toxic = [], {}
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randint(5, 120))]
        toxic[i] = int(i % 8 == 0)
        if toxic[i]:
            for _ in range(draw.randint(1, 5)):
                text.insert(draw.randint(0, len(text)), draw.choice(BAD).title())
        rows.append((i, " ".join(text), "s"))
    return rows, toxic


@pytest.mark.parametrize("clashing", [False, True])
def test_held_out_accuracy(spark, clashing):
    rows, toxic = corpus()
    docs = documents(spark, rows + [(None, "x", None)], clashing)
    labels = table(spark, [(i, 1, toxic[i]) for i in toxic if i % 3] + [(5, None, None), (None, 1, 1), (8, 1, 1)], LABELS)
    got = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + 1
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for i, r in got.items() if i is not None and r["held_out"]]
    hits = sum(r["predicted"] == toxic[r["doc_id"]] for r in held)
    assert hits / len(held) >= 0.97


def test_held_out_labels_do_not_matter(spark):
    rows, toxic = corpus(400)
    flip = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one = table(spark, [(i, 1, t) for i, t in toxic.items()], LABELS)
    two = table(spark, [(i, 1, 1 - t if flip(i) else t) for i, t in toxic.items()], LABELS)
    docs = documents(spark, rows)
    assert sorted(map(tuple, toxicity(docs, one).collect())) == sorted(map(tuple, toxicity(docs, two).collect()))


def test_awkward_rows_and_missing_labels(spark):
    docs = documents(spark, clashing=True)
    rows, toxic = corpus(300)
    labels = table(spark, [(i, 1, t) for i, t in toxic.items()], LABELS)
    none = table(spark, [], LABELS)
    assert {r["score"] for r in toxicity(docs, none).collect()} == {0.0}
    assert toxicity(documents(spark, []), labels).count() == 0
    scored = toxicity(docs, labels).collect()
    assert len(scored) == len(AWKWARD) and len({r["score"] for r in scored if r["doc_id"] in (3, 4, 5)}) == 1
    assert without_toxic(docs, none).columns == docs.columns and without_toxic(docs, none).count() == len(AWKWARD)


def test_risk_falls_to_its_minimum_and_is_corrected_by_the_prior():
    rows, toxic = corpus(1200, 3)
    sets = {i: terms(t.encode()) for i, t, _ in rows}
    positive = [sets[i] for i in toxic if toxic[i]][:80]
    model = train_nnpu(positive, list(sets.values()), 1 / 8)
    logits = np.array([model.logit(s) for s in sets.values()])
    assert np.mean((logits > 0) == np.array([toxic[i] == 1 for i in sets])) > 0.97
    assert np.isfinite(model.weight).all() and _matrix(positive, model.term).shape == (80, len(model.term))
    assert model.logit(np.zeros(0, np.uint32)) == model.bias < 0


def plain_nnpu(positive, unlabelled, chosen, prior, steps=400, rate=0.05, decay=1e-4):
    """The risk estimator row by row in double precision. Returns weights, bias and the steps in which the bracket was below zero."""
    place = {t: k for k, t in enumerate(chosen)}
    p = [[place[t] for t in s if t in place] for s in positive]
    u = [[place[t] for t in s if t in place] for s in unlabelled]
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second, below = np.zeros_like(theta), np.zeros_like(theta), 0
    for step in range(1, steps + 1):
        def risk(rows, target):
            """Mean logistic loss on rows taken for ``target`` (1 or -1), and its gradient."""
            loss, grad = 0.0, np.zeros_like(theta)
            for row in rows:
                f = theta[-1] + sum(theta[k] for k in row)
                loss += np.log1p(np.exp(-target * f)) / len(rows)
                slope = -target / (1 + np.exp(target * f)) / len(rows)
                grad[-1] += slope
                for k in row:
                    grad[k] += slope
            return loss, grad

        up, down, wrong = risk(p, 1), risk(u, -1), risk(p, -1)
        bracket = down[0] - prior * wrong[0]
        if bracket >= 0:
            grad = prior * up[1] + down[1] - prior * wrong[1]
        else:
            below += 1
            grad = -(down[1] - prior * wrong[1])
        grad[:-1] += decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta, below


def bags(seed, n, vocabulary, sure=None):
    draw = random.Random(seed)
    return [np.unique(np.array([*draw.sample(range(vocabulary), draw.randint(1, 4)), *([sure] if sure is not None else [])], np.uint32)) for _ in range(n)]


@pytest.mark.parametrize("prior, negative", [(0.2, False), (0.9, True)])
def test_training_equals_the_plain_estimator(prior, negative):
    positive, unlabelled = bags(1, 40, 30, 77), bags(2, 60, 30) + bags(3, 15, 30, 77)
    model = train_nnpu(positive, unlabelled, prior, steps=120, least=1)
    assert 77 in model.term
    theta, below = plain_nnpu(positive, unlabelled, list(model.term), prior, steps=120)
    assert (below > 0) is negative
    assert np.allclose(model.weight, theta[:-1], atol=1e-2) and model.bias == pytest.approx(theta[-1], abs=1e-2)  # single precision


def test_scores_equal_plain_models_on_the_same_texts(spark):
    """With room for all texts in the sample, every model sees every text that is not held out."""
    rows, toxic = corpus(160, 5)
    kept = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5]
    sets = {i: terms(t.encode()) for i, t, _ in rows}
    labels = table(spark, [(i, 1, toxic[i]) for i in toxic], LABELS)
    prior = sum(toxic[i] for i in kept) / len(kept)
    positive = [sets[i] for i in kept if toxic[i]]
    got = {r["doc_id"]: r["score"] for r in toxicity(documents(spark, rows), labels, classifiers=2, positives=10**6, unlabelled=10**6).collect()}
    model = train_nnpu(positive, [sets[i] for i in kept], prior)
    theta, _ = plain_nnpu(positive, [sets[i] for i in kept], list(model.term), prior)
    for i, s in sets.items():
        f = theta[-1] + sum(theta[k] for k, t in enumerate(model.term) if t in set(s))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-f)), abs=5e-3)
