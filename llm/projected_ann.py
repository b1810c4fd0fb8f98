"""Approximate nearest neighbours by stable projections and kd-trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import ref, saved

#: Vectors of a leaf of the tree.
LEAF = 64
#: Queries that a block answers together.
BATCH = 512


def chi_square_quantile(p: float, degrees: int) -> float:
    """For an even number of degrees of freedom, from the closed form of the distribution."""

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Tree:
    """A balanced kd-tree over projected vectors: leaves of about LEAF rows, each with its bounding box."""

    def __init__(self, points: np.ndarray):
        order, cuts = np.arange(len(points)), [0, len(points)]
        todo = [(0, len(points))]
        while todo:
            start, end = todo.pop()
            if end - start <= LEAF:
                continue
            rows = points[order[start:end]]
            axis = int(np.argmax(np.ptp(rows, axis=0)))
            mid = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(rows[:, axis], mid)]
            cuts.append(start + mid)
            todo += [(start, start + mid), (start + mid, end)]
        self.order, self.starts = order, np.array(sorted(set(cuts)))
        boxes = [points[order[a:b]] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]
        self.low = np.array([x.min(axis=0) for x in boxes]).reshape(len(boxes), points.shape[1])
        self.high = np.array([x.max(axis=0) for x in boxes]).reshape(len(boxes), points.shape[1])

    def distances(self, query: np.ndarray) -> np.ndarray:
        return box_distances(query, self.low, self.high)


def dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in component order, so that equal vectors have equal scores whatever stands beside them."""
    out = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        out += rows[:, k] * query[:, k]
    return out


@dataclass(frozen=True)
class Space:
    """The projections, the same for all vectors and queries.

    Vectors are lifted by one component to the common length ``longest``, queries by a zero, so that the largest inner product is
    the smallest distance. Projected by Gaussian (2-stable) directions, the squared distance of two lifted vectors is their
    true one times a chi-square variable with ``width`` degrees of freedom.
    """

    size: int
    longest: float
    width: int
    sure: float
    seed: int

    def __post_init__(self) -> None:
        draw = np.random.default_rng(self.seed)
        object.__setattr__(self, "directions", draw.standard_normal((self.size + 1, self.width)))
        object.__setattr__(self, "stop", chi_square_quantile(self.sure, self.width))

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.longest * self.longest - (rows * rows).sum(axis=1), 0))
        return rows @ self.directions[:-1] + lift[:, None] * self.directions[-1]

    def queries(self, rows: np.ndarray) -> np.ndarray:
        return (rows * (self.longest / np.sqrt((rows * rows).sum(axis=1)))[:, None]) @ self.directions[:-1]

    def admits(self, ahead: np.ndarray, kth: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """May something at this squared projected distance be nearer than the k-th best score, but for a chance of ``1 - sure``?"""
        score = kth * self.longest / np.sqrt((rows * rows).sum(axis=1))
        distance = np.where(np.isfinite(score), np.maximum(2 * self.longest**2 - 2 * score, 0), np.inf)
        return ~(ahead >= self.stop * distance)


@dataclass(frozen=True)
class Cells:
    """The top of a kd-tree over projected vectors. ``child`` is the left of two neighbouring children, or 0 for a leaf, whose cell is ``leaf``."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, most: int) -> Cells:
        """Cuts the widest cell's widest axis at the median, the largest cell first, up to ``most`` cells of at least 16 rows."""
        axis, cut, child, rows = [0], [0.0], [0], [np.arange(len(sample))]
        heap = [(-len(sample), 0)]
        while heap and len(rows) - sum(c > 0 for c in child) < most:
            size, node = heapq.heappop(heap)
            some = sample[rows[node]]
            if -size < 32:
                continue
            a = int(np.argmax(np.ptp(some, axis=0)))
            at = float(np.median(some[:, a]))
            left = some[:, a] < at
            if not left.any():
                continue
            axis[node], cut[node], child[node] = a, at, len(rows)
            for part in (rows[node][left], rows[node][~left]):
                heapq.heappush(heap, (-len(part), len(rows)))
                axis.append(0), cut.append(0.0), child.append(0), rows.append(part)
        child = np.array(child)
        return cls(np.array(axis), np.array(cut), child, np.cumsum(child == 0) - 1)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        going = np.arange(len(points))
        while len(going):
            at = node[going]
            going = going[self.child[at] > 0]
            at = node[going]
            node[going] = self.child[at] + (points[going, self.axis[at]] >= self.cut[at])
        return self.leaf[node]


def box_distances(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    out = np.zeros((len(query), len(low)))
    for axis in range(query.shape[1]):
        q = query[:, axis, None]
        gap = np.maximum(np.maximum(low[:, axis] - q, q - high[:, axis]), 0)
        out += gap * gap
    return out


class Block:
    """Answers queries over some of the vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: Space):
        self.space = space
        self.tree = Tree(space.vectors(vectors))
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]

    def nearest(self, own: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score) of the k nearest found for each query; rows with the query's id are left out, and
        those below ``bound``, a score that k candidates elsewhere reach.

        Each query takes the leaves in the order of their projected distance, in rounds of 1, 2, 4, ... leaves, and verifies
        their vectors by the true inner product. It stops when the next leaf is farther than its k-th best could be with
        probability ``sure``: projected distance² / k-th distance² >= the chi-square quantile.
        """
        reach = self.tree.distances(self.space.queries(queries))
        order = np.argsort(reach, axis=1, kind="stable")
        leaves = reach.shape[1]
        best = np.repeat(bound[:, None], k, axis=1)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active, start, step = np.arange(len(queries)), 0, 1
        active = active[self.space.admits(reach[active, order[active, 0]], best[active, -1], queries[active])]
        while len(active) and start < leaves:
            end = min(leaves, start + step)
            turn = order[active, start:end]
            found_q, found_v, found_s = [], [], []
            who, leaf = np.repeat(active, end - start), turn.ravel()
            by_leaf = np.argsort(leaf, kind="stable")
            who, leaf = who[by_leaf], leaf[by_leaf]
            edges = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = slice(self.tree.starts[leaf[a]], self.tree.starts[leaf[a] + 1])
                group = who[a:b]
                score = queries[group] @ self.vectors[rows].T
                score[own[group][:, None] == self.ids[rows]] = -np.inf
                good = score >= best[group, -1][:, None] - 1e-9 * np.abs(best[group, -1][:, None], where=np.isfinite(best[group, -1][:, None]), out=np.zeros((len(group), 1)))
                good &= score > -np.inf
                q, v = np.nonzero(good)
                found_q.append(group[q])
                found_v.append(v + rows.start)
                found_s.append(score[good])
            q, v, s = np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)
            pairs.append((q, v, s))
            by = np.lexsort((-s, q))
            q, s = q[by], s[by]
            place = np.arange(len(q)) - np.repeat(np.flatnonzero(np.r_[True, q[1:] != q[:-1]]), np.diff(np.flatnonzero(np.r_[True, q[1:] != q[:-1], True]))) if len(q) else q
            top = np.full((len(queries), k), -np.inf)
            top[q[place < k], place[place < k]] = s[place < k]
            best = -np.sort(-np.concatenate([best, top], axis=1), axis=1)[:, :k]
            start, step = end, step * 2
            if start >= leaves:
                break
            ahead = reach[active, order[active, start]]
            active = active[self.space.admits(ahead, best[active, -1], queries[active])]
        q, v, s = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 3
        slack = 1e-9 * np.maximum(1.0, np.where(np.isfinite(best[:, -1]), np.abs(best[:, -1]), 0.0))
        keep = s >= best[q, -1] - slack[q]
        q, v = q[keep], v[keep]
        exact = dot(self.vectors[v], queries[q])
        by = np.lexsort((self.ids[v], -exact, q))
        q, v, exact = q[by], v[by], exact[by]
        if len(q):
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            q, v, exact = q[place < k], v[place < k], exact[place < k]
        return q, self.ids[v], exact


def _usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _search(space: Space, k: int):
    """mapInArrow over rows sorted by block: its vectors come first and are indexed, then its queries, which are answered batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, index, waiting, asked = None, [], [], None, [], 0

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, asked
            if waiting and index is not None:
                own, queries, bound = (np.concatenate(x) for x in zip(*waiting, strict=True))
                for some in range(0, len(own), BATCH):
                    now = slice(some, some + BATCH)
                    q, found, score = index.nearest(own[now], queries[now], bound[now], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[now][q]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])
            waiting, asked = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            at, asks = batch["block"].to_numpy(), ~np.isnan(batch["bound"].to_numpy(zero_copy_only=False))
            number, bound = batch["id"].to_numpy(), batch["bound"].to_numpy(zero_copy_only=False)
            vectors = _vectors(batch["vector"], len(at))
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (asks[1:] != asks[:-1]), True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if at[a] != block:
                    yield from answer()
                    block, ids, rows, index = at[a], [], [], None
                if not asks[a]:
                    ids.append(number[a:b])
                    rows.append(vectors[a:b])
                    continue
                if index is None and ids:
                    index = Block(np.concatenate(ids), np.concatenate(rows), space)
                    ids, rows = [], []
                waiting.append((number[a:b], vectors[a:b], bound[a:b]))
                asked += b - a
                if asked >= BATCH:
                    yield from answer()
        yield from answer()

    return run


_ROW = "block bigint, id bigint, vector array<double>, bound double"


def _rows(batch: pa.RecordBatch, rows: np.ndarray, block: np.ndarray, bound: np.ndarray | None) -> pa.RecordBatch:
    take = pa.array(rows)
    bounds = pa.nulls(len(rows), pa.float64()) if bound is None else pa.array(bound)
    return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), batch["id"].take(take), batch["vector"].take(take), bounds], ["block", "id", "vector", "bound"])


@dataclass(frozen=True)
class Layout:
    """Where vectors lie: the bounding box of each cell, its number of blocks and the first of them."""

    cells: Cells
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray
    first: np.ndarray


def lay_out(data: DataFrame, space: Space, total: int, block_rows: int, sample_rows: int) -> Layout:
    """Cells of about ``block_rows`` vectors by projected position, their tree fitted on about ``sample_rows`` projected vectors chosen by a hash.
    All vectors are then assigned, and counted, and the boxes are theirs, not the sample's. A cell with more rows than
    that, such as one of equal vectors, is several blocks with one box."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(space.vectors(_vectors(batch["vector"], batch.num_rows))))], ["p"])

    share = min(1.0, sample_rows / total)
    some = data if share == 1.0 else data.where(F.shiftrightunsigned(F.xxhash64("id", "vector"), 32) < F.lit(int(share * (1 << 32))))
    points = some.select("id", "vector").mapInArrow(project, "p array<double>").toArrow()["p"].combine_chunks()
    sample = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, space.width)
    cells = Cells.fit(sample[np.lexsort(sample.T)], -(-total // block_rows))
    count = int(cells.leaf[-1]) + 1

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((count, space.width), np.inf), np.full((count, space.width), -np.inf)
        rows = np.zeros(count, np.int64)
        for batch in batches:
            if batch.num_rows:
                p = space.vectors(_vectors(batch["vector"], batch.num_rows))
                cell = cells.of(p)
                np.minimum.at(low, cell, p)
                np.maximum.at(high, cell, p)
                rows += np.bincount(cell, minlength=count)
        here = np.flatnonzero(rows)
        at = [np.repeat(here, space.width), np.tile(np.arange(space.width), len(here)), low[here].ravel(), high[here].ravel(), np.repeat(rows[here], space.width)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in at], ["cell", "axis", "low", "high", "n"])

    boxes = data.select("vector").mapInArrow(bound, "cell bigint, axis bigint, low double, high double, n bigint").groupBy("cell", "axis")
    low, high, rows = np.full((count, space.width), np.inf), np.full((count, space.width), -np.inf), np.zeros(count, np.int64)
    for r in boxes.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        low[r["cell"], r["axis"]], high[r["cell"], r["axis"]], rows[r["cell"]] = r["low"], r["high"], r["n"]
    blocks = -(-rows // block_rows)
    return Layout(cells, low, high, blocks, np.cumsum(blocks) - blocks)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    width: int = 16,
    sure: float = 0.97,
    block_rows: int = 4096,
    sample_rows: int = 1 << 17,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each of ``queries`` by inner product in double precision: query_id, rank from 1, vec_id, score. Nearest
    first, ties to the smaller id; a vector with the query's own id is no candidate. All candidates, if fewer than ``k``.

    Vectors lie in cells of a kd-tree over ``width`` stable projections, each with a kd-tree of its own; see ``lay_out``. A query first asks
    one block of the cell nearest to it. The k-th score found there bounds what it needs: in a second round it asks only the blocks of cells
    whose box the chi-square test still admits, and in each only the leaves that it admits, from that bound on. A block's vectors
    are read before its queries, which stream past, so a task holds one block and one batch however many queries there are. A
    neighbour is missed with a probability of at most ``1 - sure``. Vectors without structure admit most cells; those in groups, few.

    Takes no part: a vector that is null, empty, zero or has a null or non-finite component, one with a null id, or one whose
    length is not the most frequent one (ties: the shorter). Rows repeated with one id are candidates each; a query repeated
    with one id is asked once, with its smallest vector. Empty tables give an empty result.
    """

    def usable(rows: DataFrame) -> DataFrame:
        vector = ref(vector_col).cast("array<double>")
        return rows.select(ref(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & _usable(F.col("vector")))

    data = usable(vectors)
    sizes = data.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    size = sizes.orderBy(F.desc("rows"), "n").first()
    schema = "query_id bigint, vec_id bigint, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    data = data.where(F.size("vector") == size["n"])
    asked = saved(usable(queries).where(F.size("vector") == size["n"]).groupBy("id").agg(F.min("vector").alias("vector")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    space = Space(size["n"], math.sqrt(data.agg(F.max(square)).first()[0]), width, sure, seed)
    layout = lay_out(data, space, size["rows"], block_rows, sample_rows)
    total = int(layout.blocks.sum())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = layout.cells.of(space.vectors(_vectors(batch["vector"], batch.num_rows)))
                turn = batch["turn"].to_numpy(zero_copy_only=False) % np.maximum(layout.blocks[cell], 1)
                yield _rows(batch, np.arange(batch.num_rows), layout.first[cell] + turn, None)

    def home(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distances to all boxes, and the first block to ask."""
        reach = box_distances(space.queries(rows), layout.low, layout.high)
        cell = reach.argmin(axis=1)
        return reach, layout.first[cell] + ids % layout.blocks[cell]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, block = home(_vectors(batch["vector"], batch.num_rows), batch["id"].to_numpy())
                yield _rows(batch, np.arange(batch.num_rows), block, np.full(batch.num_rows, -np.inf))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                rows = _vectors(batch["vector"], batch.num_rows)
                bound = batch["bound"].to_numpy(zero_copy_only=False)
                reach, own = home(rows, batch["id"].to_numpy())
                who, cell = np.nonzero(np.stack([space.admits(c, bound, rows) for c in reach.T], axis=1) & (layout.blocks > 0))
                many = layout.blocks[cell]
                who, block = np.repeat(who, many), np.repeat(layout.first[cell], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                who, block = who[block != own[who]], block[block != own[who]]
                yield _rows(batch, who, block, bound[who])

    dealt = data.withColumn("turn", F.shiftrightunsigned(F.xxhash64("id", "vector"), 33)).mapInArrow(placed, _ROW)

    def answered(asking: DataFrame) -> DataFrame:
        both = dealt.unionAll(asking).repartition(total, "block").sortWithinPartitions("block", F.asc_nulls_first("bound"), "id")
        return saved(both.mapInArrow(_search(space, k), schema))

    one = answered(asked.mapInArrow(first, _ROW))
    reached = one.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    bounded = asked.join(reached, F.col("id") == F.col("query_id"), "left").select("id", "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    found = one.unionAll(answered(bounded.mapInArrow(others, _ROW)))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
