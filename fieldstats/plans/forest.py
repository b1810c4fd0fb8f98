"""Regression trees grown in tasks, each from a bounded bag of binned rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.functions.coerce import ref


@dataclass(frozen=True)
class Tree:
    """Nodes in the order of their levels. ``left`` is 0 for leaves, else the first of two neighbouring children; rows whose bin of ``feature``
    is at most ``cut`` go there."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gains: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(bins.shape[1], np.int32)
        rows = np.arange(bins.shape[1])
        while len(rows):
            at = node[rows]
            rows = rows[self.left[at] > 0]
            at = node[rows]
            node[rows] = self.left[at] + (bins[self.feature[at], rows] > self.cut[at])
        return self.value[node]


@dataclass(frozen=True)
class Forest:
    features: tuple[str, ...]
    target: str
    edges: tuple[np.ndarray, ...]
    trees: tuple[Tree, ...]

    def importances(self) -> list[float]:
        """Shares of the squared error taken away by the splits on each feature: per tree, averaged, adding up to 1 unless no tree has a split."""
        each = [t.gains / t.gains.sum() for t in self.trees if t.gains.sum() > 0]
        mean = np.mean(each, axis=0) if each else np.zeros(len(self.features))
        return [float(g) for g in mean / (mean.sum() or 1.0)]

    def predict(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """Features, target and the mean of all trees, for rows without NULLs. The model is bounded by trees x rows of a bag."""
        sent = rows.sparkSession.sparkContext.broadcast(self)
        names = [*self.features, self.target]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                if batch.num_rows:
                    bins, which = _distinct(_binned(batch, model.edges))
                    mean = sum(t.predict(bins) for t in model.trees) / len(model.trees)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean[which])], [*[f"c{i}" for i in range(len(names))], "p"])

        slim = rows.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
        shape = ", ".join(f"c{i} double" for i in range(len(names))) + ", p double"
        return slim.mapInArrow(run, shape).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("p").alias(name))


def _binned(batch: pa.RecordBatch, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each feature (a row) and batch row (a column): how many edges lie below the value."""
    return np.array([np.searchsorted(e, batch[i].to_numpy(zero_copy_only=False)) for i, e in enumerate(edges)], dtype=np.uint16)


def _distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns, and which of them each column is."""
    order = np.lexsort(bins)
    placed = bins[:, order]
    new = np.r_[True, (placed[:, 1:] != placed[:, :-1]).any(axis=0)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return placed[:, new], which


def grow(bins: np.ndarray, y: np.ndarray, seed: int, max_depth: int | None = None) -> Tree:
    """A tree down to pure or indivisible leaves, or to ``max_depth`` levels of splits, level by level over all nodes at once.

    Rows with equal bins are one weighted row. Each level sorts the rows of open nodes by node and bin; running sums then give the squared
    error that every cut takes away. Of equal cuts of different features one is drawn: where two rows are left, all features that
    tell them apart are equally good, and none may be favoured.
    """
    rng = np.random.default_rng(seed)
    bins, which = _distinct(bins)
    p, m = bins.shape
    weight = np.bincount(which, minlength=m).astype(np.float64)
    total, square = np.bincount(which, y, m), np.bincount(which, y * y, m)
    floor = 1e-12 * max(float(square.sum()), 1e-300)
    features, cuts, lefts, values = [], [], [], []
    gains = np.zeros(p)
    rows, node, count, made = np.arange(m), np.zeros(m, np.int64), 1, 1
    while count:
        w, s, q = (np.bincount(node, x[rows], count) for x in (weight, total, square))
        own = s * s / w
        best, drawn = np.full(count, -np.inf), np.zeros(count)
        feature, cut = np.zeros(count, np.int16), np.zeros(count, np.int32)
        for f in range(p):
            order = np.lexsort((bins[f, rows], node))
            at, b = node[order], bins[f, rows[order]].astype(np.int32)
            ends = np.flatnonzero((at[1:] == at[:-1]) & (b[1:] != b[:-1]))
            if not len(ends):
                continue
            here = at[ends]
            first = np.searchsorted(at, np.arange(count))
            cw, cs = np.cumsum(weight[rows[order]]), np.cumsum(total[rows[order]])
            wl = cw[ends] - np.r_[0.0, cw][first[here]]
            sl = cs[ends] - np.r_[0.0, cs][first[here]]
            gain = sl * sl / wl + (s[here] - sl) ** 2 / (w[here] - wl) - own[here]
            top = np.full(count, -np.inf)
            np.maximum.at(top, here, gain)
            hit = np.flatnonzero(gain == top[here])
            found, at_hit = np.unique(here[hit], return_index=True)
            ticket = rng.random(count)
            slack = 1e-9 * np.abs(top[found])
            better = (top[found] > best[found] + slack) | ((top[found] >= best[found] - slack) & (ticket[found] > drawn[found]))
            take = found[better]
            best[take], drawn[take], feature[take] = top[take], ticket[take], f
            cut[take] = b[ends[hit[at_hit[better]]]]
        split = (best > -np.inf) & (q - own > floor) & (max_depth is None or len(features) < max_depth)
        np.add.at(gains, feature[split], np.maximum(best[split], 0.0))
        rank = np.cumsum(split) - 1
        features.append(feature)
        cuts.append(cut)
        lefts.append(np.where(split, made + 2 * rank, 0))
        values.append(s / w)
        made += 2 * int(split.sum())
        open_rows = split[node]
        rows, node = rows[open_rows], node[open_rows]
        node = 2 * rank[node] + (bins[feature[node], rows] > cut[node])
        count = 2 * int(split.sum())
    return Tree(np.concatenate(features), np.concatenate(cuts).astype(np.uint16), np.concatenate(lefts).astype(np.int32), np.concatenate(values), gains)


def fit(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    trees: int = 200,
    bag_rows: int = 16_384,
    max_bins: int = 256,
    max_depth: int | None = None,
    seed: int = 42,
) -> Forest:
    """A forest on ``rows`` (no NULLs), each tree from a bag of its own in a task of its own.

    A row enters a bag Poisson(1) times, as in drawing with replacement, where there are at most ``bag_rows`` rows; beyond, so rarely that a
    bag holds about ``bag_rows``. For all bags together that is one draw a row, Poisson(trees x rate), and one bag for each entry: nothing is
    multiplied by the number of trees first. Features travel as numbers of bins between at most ``max_bins`` - 1 values, which one aggregate finds
    (all values of a feature with few); target values as they are. So shuffle, tasks and model are bounded by trees x bag_rows however
    many rows there are. Draws depend on the scan position, so a repeated task draws the same rows.
    """
    names = [*features, target]
    slim = rows.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("at"))
    shares = [k / max_bins for k in range(1, max_bins)]
    wanted = [F.percentile_approx(f"c{i}", shares, 10_000).alias(f"q{i}") for i in range(len(features))]
    facts = slim.agg(F.count(F.lit(1)).alias("n"), F.avg(f"c{len(features)}").alias("mean"), *wanted).first()
    n, centre = facts["n"], facts["mean"] or 0.0
    edges = tuple(np.unique(np.array(facts[f"q{i}"] or [], dtype=np.float64)) for i in range(len(features)))
    rate = trees * min(1.0, bag_rows / max(n, 1))
    chances = _poisson(rate)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            draw = batch["draw"].to_numpy(zero_copy_only=False).view(np.uint64)
            times = np.searchsorted(chances, (draw >> np.uint64(11)) / float(1 << 53), side="right")
            row = np.repeat(np.arange(batch.num_rows), times)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            bag = _mixed(draw[row], turn) % np.uint64(trees)
            order = np.argsort(bag, kind="stable")
            bag, row = bag[order].astype(np.int64), row[order]
            bins = _binned(batch, edges)[:, row]
            y = batch[len(edges)].to_numpy(zero_copy_only=False)[row] - centre
            start = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]]) if len(bag) else []
            stop = [*start[1:], len(bag)]
            columns = [
                pa.array(bag[start], pa.int32()) if len(bag) else pa.array([], pa.int32()),
                pa.array([bins[:, a:b].tobytes() for a, b in zip(start, stop, strict=False)], pa.binary()),
                pa.array([y[a:b].tobytes() for a, b in zip(start, stop, strict=False)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "bins", "y"])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["tree"].iloc[0])
        parts = sorted(zip(group["bins"], group["y"], strict=True))
        bins = np.concatenate([np.frombuffer(b, np.uint16).reshape(len(edges), -1) for b, _ in parts], axis=1)
        y = np.concatenate([np.frombuffer(v, np.float64) for _, v in parts])
        t = grow(bins, y, seed * 1_000_003 + number, max_depth)
        packed = [x.tobytes() for x in (t.feature, t.cut, t.left, t.value + centre, t.gains)]
        return pd.DataFrame({"tree": [number], **{k: [v] for k, v in zip(("feature", "cut", "left", "value", "gains"), packed, strict=True)}})

    drawn = slim.select(*[f"c{i}" for i in range(len(names))], F.xxhash64(F.lit(seed), "at").alias("draw"))
    packed = drawn.mapInArrow(bags, "tree int, bins binary, y binary").repartition(trees, "tree")
    shape = "tree int, feature binary, cut binary, left binary, value binary, gains binary"
    grown = sorted(packed.groupBy("tree").applyInPandas(one, shape).collect(), key=lambda r: r["tree"])
    kinds = (np.int16, np.uint16, np.int32, np.float64, np.float64)
    built = tuple(Tree(*[np.frombuffer(r[k], t) for k, t in zip(("feature", "cut", "left", "value", "gains"), kinds, strict=True)]) for r in grown)
    return Forest(tuple(features), target, edges, built)


def _poisson(rate: float) -> np.ndarray:
    """Chances of at most 0, 1, 2, … entries, as far as a double tells them from 1."""
    k = np.arange(1, int(rate + 12 * np.sqrt(rate) + 20))
    logs = -rate + np.r_[0.0, np.cumsum(np.log(rate) - np.log(k))]
    return np.cumsum(np.exp(logs))


def _mixed(draw: np.ndarray, turn: np.ndarray) -> np.ndarray:
    h = draw + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
