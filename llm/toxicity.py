"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ref, text_bytes

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_SCALE = 1 << 32


def terms(text: bytes) -> np.ndarray:
    """The distinct words of a text (letters, A-Z lower-cased) as sorted 32-bit numbers."""
    words = set(_WORD.findall(text.translate(_LOWER)))
    return np.unique(np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)))


@dataclass(frozen=True)
class Classifier:
    """A linear score over the presence of terms."""

    term: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, present: np.ndarray) -> float:
        if not len(self.term) or not len(present):
            return self.bias
        at = np.searchsorted(self.term, present)
        at[at == len(self.term)] = 0
        return self.bias + float(self.weight[at[self.term[at] == present]].sum())


def _matrix(docs: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    out = np.zeros((len(docs), len(chosen)), dtype=np.float32)
    for row, present in enumerate(docs):
        out[row, np.isin(chosen, present, assume_unique=True)] = 1.0
    return out


def _choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: int, most: int) -> np.ndarray:
    """Terms in at least ``least`` texts whose share differs most clearly between the two sets (z of two proportions over 4)."""
    if not positive or not unlabelled:
        return np.zeros(0, np.uint32)
    term, count = np.unique(np.concatenate(positive), return_counts=True)
    other, against = np.unique(np.concatenate(unlabelled), return_counts=True)
    every = np.union1d(term, other)
    p, u = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, term)] = count
    u[np.searchsorted(every, other)] = against
    n, m = len(positive), len(unlabelled)
    pooled = (p + u) / (n + m)
    z = (p / n - u / m) / np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / n + 1 / m), 1e-12))
    good = np.flatnonzero((np.abs(z) >= 4) & (p + u >= least))
    return np.sort(every[good[np.argsort(-np.abs(z[good]), kind="stable")[:most]]])


def train_nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    steps: int = 400,
    rate: float = 0.05,
    decay: float = 1e-4,
    least: int = 5,
    most: int = 512,
) -> Classifier:
    """Minimises ``prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])`` with the logistic loss l, by Adam on all rows.

    The bracket is the risk on negatives, estimated without any negative example: unlabelled texts hold the share ``prior`` of
    positives, whose part is taken off. Where the estimate falls below zero, which only over-fitting can do, the step
    goes up the bracket instead of down the sum.
    """
    chosen = _choose(positive, unlabelled, least, most)
    p, u = _matrix(positive, chosen), _matrix(unlabelled, chosen)
    w, b = np.zeros(len(chosen), np.float32), np.float32(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-(p @ w + b))), 1 / (1 + np.exp(-(u @ w + b)))
        negative = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-7))) - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-7)))
        from_p, from_u = -prior * sp / len(sp), su / len(su)
        if negative >= 0:
            from_p = from_p + prior * (sp - 1) / len(sp)
        else:
            from_p, from_u = -from_p, -from_u
        grad = np.append(p.T @ from_p + u.T @ from_u + decay * w, from_p.sum() + from_u.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return Classifier(chosen, w.astype(np.float64), float(b))


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text divides by 5. A null id counts as held out."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 5 == 0


def _chance(id_column: Column, salt: Column | int) -> Column:
    """A number in [0, 2^32) that depends on the id alone."""
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    return F.shiftrightunsigned(F.xxhash64(id_column.cast("string"), salt), 32)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    classifiers: int = 3,
    positives: int = 3000,
    unlabelled: int = 9000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[Classifier]:
    """Trains ``classifiers`` models, each in a task of its own, on the texts with ``labels.toxic`` = 1 as confirmed positives and on texts
    regardless of labels as unlabelled ones. Held-out ids give neither. An id with a label 1 is positive, other labels of it or not.
    A model knows at most 512 terms (``most`` of ``train_nnpu``), those of its sample that tell the two sets apart best, each in 5 texts or more (``least``).

    The sample is bounded: about ``positives`` and ``unlabelled`` texts for each model, chosen by a hash of the id that differs by
    model. The class prior is the share of toxic rows among all labelled rows that are not held out, counted over the
    whole table. Texts become sets of term numbers where they are; only the chosen ids are sent to all tasks and only
    models come back. Without a positive or an unlabelled text there are no models.
    """
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    facts = marks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).first()
    open_docs = docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).cast("string").alias("text")).where(~held_out(F.col("id")))
    total = open_docs.select("id").count()
    if not facts["toxic"] or not total:
        return []
    prior = min(max(facts["toxic"] / facts["n"], 1e-4), 0.9)
    bags = F.explode(F.sequence(F.lit(0), F.lit(classifiers - 1))).alias("bag")

    def drawn(rows: DataFrame, salt: int, most: int, out_of: int) -> DataFrame:
        rows = rows.select("*", bags)
        limit = min(_SCALE, int(_SCALE * most / out_of))
        return rows.where(_chance(F.col("id"), F.col("bag") * 2 + salt) < limit)

    ids = marks.where("toxic = 1").select(F.col("doc_id").cast("long").alias("id")).distinct()
    chosen = drawn(ids, 0, positives, facts["toxic"]).groupBy("id").agg(F.sort_array(F.collect_list("bag")).alias("bags"))
    chosen = chosen.limit(2 * positives * classifiers)  # a bound for the broadcast; the draw stays below it
    found = open_docs.join(F.broadcast(chosen), "id").select("id", "text", "bags", F.lit(1).alias("positive"))
    every = F.array(*[F.when(_chance(F.col("id"), bag * 2 + 1) < min(_SCALE, int(_SCALE * unlabelled / total)), F.lit(bag)) for bag in range(classifiers)])
    others = open_docs.select("id", "text", F.array_compact(every).alias("bags"), F.lit(0).alias("positive")).where(F.size("bags") > 0)

    def presence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([terms(t.as_py()).tobytes() for t in batch], pa.binary())

    presence.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    sample = found.unionByName(others).withColumn("terms", F.arrow_udf(presence, "binary")(text_bytes(F.col("text"))))
    sample = sample.select("id", "positive", "terms", F.explode("bags").alias("bag"))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["positive", "id", "terms"])
        sets = [np.frombuffer(t, dtype=np.uint32) for t in group["terms"]]
        of = group["positive"].to_numpy()
        p, u = [s for s, k in zip(sets, of, strict=True) if k], [s for s, k in zip(sets, of, strict=True) if not k]
        if not p or not u:
            return pd.DataFrame({"bag": [], "term": [], "weight": [], "bias": []}, dtype=object)
        model = train_nnpu(p, u, prior)
        return pd.DataFrame(
            {"bag": [int(group["bag"].iloc[0])], "term": [model.term.astype(np.int64)], "weight": [model.weight], "bias": [model.bias]}
        )

    models = sample.groupBy("bag").applyInPandas(train, "bag int, term array<bigint>, weight array<double>, bias double").collect()
    return [
        Classifier(np.array(m["term"], dtype=np.uint32), np.array(m["weight"], dtype=np.float64), m["bias"])
        for m in sorted(models, key=lambda m: m["bag"])
    ]


def scores(text: Column, models: list[Classifier]) -> Column:
    """The mean of the models' logits as a probability; 0 for all texts if there are no models. Models are some kilobytes and go with
    the task."""
    if not models:
        return F.lit(0.0)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [terms(t.as_py()) for t in batch]
            logits = np.array([[m.logit(s) for m in models] for s in sets], dtype=np.float64).reshape(len(sets), len(models))
            yield pa.array(1 / (1 + np.exp(-logits.mean(axis=1))))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")(text_bytes(text))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per row of ``docs``: the id, ``held_out``, ``score`` (0 to 1) of the whole text and ``predicted`` (1 from a score of 0.5).

    The text alone decides the score. Null and empty texts get the score of a text without any known word. A null id is held
    out. Repeated rows stay repeated; repeated labels count once for training and as often as they stand for the
    prior; null labels are ignored. Empty documents give an empty table, empty labels a score of 0 for every row. Other columns
    are not looked at.
    """
    models = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(ref(id_col).alias(id_col), held_out(ref(id_col)).alias("held_out"), scores(ref(text_col).cast("string"), models).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the models do not call toxic."""
    models = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    return docs.where(scores(ref(text_col).cast("string"), models) < 0.5)
