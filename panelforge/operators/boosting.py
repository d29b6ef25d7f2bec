"""Gradient-boosted trees grown leaf by leaf from sums by bin.

Features are cut into quantile bins once. Gradients of a node's rows are summed by feature and bin where the rows are, and
Spark adds the sums up; one job does so for all nodes of a depth. A split's gain doesn't depend on the order
of splits, so nodes are looked at depth by depth, and the tree is then grown best first from the gains at hand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.stored import stored

#: Trees after which predictions so far are written, so that a job applies no more than these.
STORED_EVERY = 10


@dataclass(frozen=True)
class Growth:
    leaves: int = 32
    depth: int = 8
    rate: float = 0.05
    l1: float = 0.1
    l2: float = 0.1
    bins: int = 255
    least: int = 20
    """Rows of a leaf, at least."""


@dataclass
class Tree:
    """Nodes by number (root 1, children 2 i and 2 i + 1): the feature and the last bin that goes left, and the value of leaves."""

    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        return cls(np.full(1 << (depth + 1), -1), np.zeros(1 << (depth + 1), np.int64), np.zeros(1 << (depth + 1)))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row ends in."""
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[at]
            on = f >= 0
            if not on.any():
                return at
            right = bins[rows[on], f[on]] > self.last[at[on]]
            at[on] = 2 * at[on] + right

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class Model:
    cuts: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """The number of cuts below each value."""
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.start + sum((t(b) for t in self.trees), np.zeros(len(x)))


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_split(g: np.ndarray, n: np.ndarray, growth: Growth) -> tuple[float, int, int] | None:
    """(gain, feature, last bin that goes left) of a node's sums by feature and bin, if any split helps."""
    left_g, left_n = g.cumsum(1)[:, :-1], n.cumsum(1)[:, :-1]
    all_g, all_n = g[0].sum(), n[0].sum()
    score = lambda a, b: shrunk(a, growth.l1) ** 2 / (b + growth.l2)
    gain = score(left_g, left_n) + score(all_g - left_g, all_n - left_n) - score(all_g, all_n)
    gain = np.where((left_n >= growth.least) & (all_n - left_n >= growth.least), gain, -np.inf)
    if not gain.size:
        return None
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-10 else None


def grown(sums, growth: Growth, features: int) -> Tree:
    """A tree from ``sums(tree, nodes)``: gradient and row sums [node, feature, bin] of the rows that ``tree`` leads to each of ``nodes``."""
    full, splits, totals = Tree.empty(growth.depth), {}, {}
    frontier = [1]
    for _ in range(growth.depth):
        if not frontier:
            break
        g, n = sums(full, frontier)
        below = []
        for i, node in enumerate(frontier):
            totals[node] = g[i, 0].sum(), n[i, 0].sum()
            if found := best_split(g[i], n[i], growth):
                splits[node] = found
                _, f, b = found
                full.feature[node], full.last[node] = f, b
                left = g[i, f, : b + 1].sum(), n[i, f, : b + 1].sum()
                totals[2 * node], totals[2 * node + 1] = left, (totals[node][0] - left[0], totals[node][1] - left[1])
                below += [c for c in (2 * node, 2 * node + 1) if totals[c][1] >= 2 * growth.least]
        frontier = below
    tree, open_, leaves = Tree.empty(growth.depth), [(-splits[1][0], 1)] if 1 in splits else [], 1
    while open_ and leaves < growth.leaves:
        _, node = heapq.heappop(open_)
        _, tree.feature[node], tree.last[node] = splits[node]
        leaves += 1
        for c in (2 * node, 2 * node + 1):
            if c in splits:
                heapq.heappush(open_, (-splits[c][0], c))
    for node in {1} | {c for i in np.flatnonzero(tree.feature >= 0) for c in (2 * i, 2 * i + 1)}:
        if tree.feature[node] < 0 and node in totals:
            g, n = totals[node]
            tree.value[node] = -growth.rate * float(shrunk(np.array(g), growth.l1)) / (n + growth.l2)
    return tree


def fit(train: DataFrame, columns: Sequence[str], trees: int = 200, growth: Growth = Growth(), error: float = 1e-3) -> Model:
    """Squared-error trees over ``train`` (``columns`` and y).

    What reaches the driver is bounded by the parameters: sums by node, feature and bin. ``error``: of the quantiles that cut
    the features, relative to the rows.
    """
    names, k, width = list(columns), len(columns), growth.bins + 1
    cuts = [np.unique(c) for c in train.approxQuantile(names, [i / growth.bins for i in range(1, growth.bins)], error)]
    model = Model(cuts, float(train.agg(F.avg("y")).first()[0] or 0.0))
    if not all(map(len, cuts)):
        return model

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in names], 1)
            bins = model.binned(x).astype(np.uint8 if width <= 256 else np.uint16)
            yield pa.record_batch([pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(b.column("y").to_numpy() - model.start)], ["b", "left"])

    def unpacked(b: pa.RecordBatch) -> np.ndarray:
        kind = np.uint8 if width <= 256 else np.uint16
        return np.frombuffer(b"".join(b.column("b").to_pylist()), kind).reshape(-1, k)

    rows, fresh = stored(train.select(*names, "y").mapInArrow(prepared, "b binary, left double")), []

    def less(trees: list[Tree]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                left = b.column("left").to_numpy() - sum((t(unpacked(b)) for t in trees), 0.0) if b.num_rows else b.column("left")
                yield pa.record_batch([b.column("b"), pa.array(left)], ["b", "left"])

        return run

    def sums(tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(1 << (growth.depth + 1), -1)
        place[nodes] = np.arange(len(nodes))
        trees = list(fresh)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, n = np.zeros(len(nodes) * k * width), np.zeros(len(nodes) * k * width)
            for b in batches:
                if not b.num_rows:
                    continue
                bins = unpacked(b)
                gradient = -(b.column("left").to_numpy() - sum((t(bins) for t in trees), 0.0))
                at = place[tree.nodes(bins)]
                for j in range(k):
                    i = ((at * k + j) * width + bins[:, j])[at >= 0]
                    g += np.bincount(i, gradient[at >= 0], len(g))
                    n += np.bincount(i, minlength=len(n))
            i = np.flatnonzero(n)
            yield pa.record_batch([pa.array(i), pa.array(g[i]), pa.array(n[i])], ["i", "g", "n"])

        found = rows.mapInArrow(run, "i long, g double, n double").groupBy("i").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
        out = np.zeros((2, len(nodes) * k * width))
        out[:, found.column("i").to_numpy()] = found.column("g").to_numpy(), found.column("n").to_numpy()
        return tuple(out.reshape(2, len(nodes), k, width))

    for _ in range(trees):
        tree = grown(sums, growth, k)
        if tree.feature[1] < 0:
            break
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == STORED_EVERY:
            rows, fresh = stored(rows.mapInArrow(less(list(fresh)), "b binary, left double")), []
    return model


def predicted(model, columns: Sequence[str]) -> Column:
    """``model.predict`` of the columns."""

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.predict(x.to_numpy(dtype=float)))

    return run(F.struct(*columns))
