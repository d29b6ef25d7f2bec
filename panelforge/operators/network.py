"""A feed-forward network fitted by Adam where the rows are.

In a pass, every partition takes its own mini-batch steps from the common weights; the weights and Adam's moments that
they end with are averaged by their rows, and the next pass begins there. Only these pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Adam's constants, and by how much a loss must fall to count as better (fixed values).
BETA, SECOND, TINY, BETTER = 0.9, 0.999, 1e-8, 1e-6

#: Rows of a worker, at most.
WORKER_ROWS = 1 << 20


@dataclass
class Network:
    """Layers of rectified units and a linear last one; weights and biases of all layers lie in one array."""

    sizes: tuple[int, ...]
    w: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.w is None:
            rng = np.random.default_rng(0)
            parts = [rng.uniform(-1, 1, (a + 1) * b) / np.sqrt(a) for a, b in zip(self.sizes, self.sizes[1:])]
            self.w = np.concatenate(parts)

    def layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        *inner, (w, b) = self.layers(self.w)
        for v, c in inner:
            x = np.maximum(x @ v + c, 0)
        return (x @ w + b)[:, 0]

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None) -> np.ndarray:
        """Of the mean squared error; ``dropout``: share of inner units that a step does without, the others scaled up."""
        layers, seen, masks = self.layers(w), [x], []
        for v, c in layers[:-1]:
            z = seen[-1] @ v + c
            mask = (z > 0) / 1.0
            if dropout:
                mask *= (rng.random(z.shape) >= dropout) / (1 - dropout)
            masks.append(mask)
            seen.append(z * mask)
        v, c = layers[-1]
        back = 2 * (seen[-1] @ v + c - y[:, None]) / len(y)
        grads: list[np.ndarray] = []
        for i in range(len(layers) - 1, -1, -1):
            grads += [back.sum(0), (seen[i].T @ back).ravel()]
            if i:
                back = (back @ layers[i][0].T) * masks[i - 1]
        return np.concatenate(grads[::-1])


@dataclass
class Adam:
    """Weights with their moments and the number of steps."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: float = 0.0

    def step(self, g: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.m = BETA * self.m + (1 - BETA) * g
        self.v = SECOND * self.v + (1 - SECOND) * g * g
        self.w = self.w - rate * (self.m / (1 - BETA**self.steps)) / (np.sqrt(self.v / (1 - SECOND**self.steps)) + TINY)


def held_out(train: DataFrame, share: float = 0.1) -> DataFrame:
    """``train`` with late: whether a row is among the last ``share`` by date and instrument (one at least).

    Only counts by date are collected; ranks are taken on the one date that the cut goes through.
    """
    counts = train.groupBy("date_idx").count().orderBy(F.desc("date_idx")).collect()
    n = sum(r["count"] for r in counts)
    left, cut = max(int(n * share), 1), -1
    for r in counts:
        cut = r.date_idx
        if left <= r["count"]:
            break
        left -= r["count"]
    on_cut = F.col("date_idx") == cut
    place = F.row_number().over(Window.partitionBy("date_idx").orderBy(F.desc("inst_ord")))
    split = train.where(on_cut).withColumn("late", place <= left)
    return train.where(~on_cut).withColumn("late", F.col("date_idx") > cut).unionByName(split)


def fit(
    train: DataFrame, columns: Sequence[str], hidden: Sequence[int] = (256, 128, 64), rate: float = 1e-3, dropout: float = 0.3, batch: int = 1024, passes: int = 50,
    patience: int = 5, workers: int | None = None, seed: int = 0,
) -> tuple[Network, list[float]]:
    """The network that did best on the last tenth of ``train`` (``columns``, y, date_idx, inst_ord), and that loss after each pass.

    It ends when the loss hasn't become better for ``patience`` passes. The loss of a pass is measured by the job of the
    next. ``workers``: partitions, each of which is held in memory as a matrix; more of them average more and step less.
    Unless said, they are as many as leave each some steps a pass, but no more than WORKER_ROWS rows.
    """
    names = list(columns)
    n = train.count()
    workers = workers or max(1, min(64, n // (16 * batch)), -(-n // WORKER_ROWS))
    rows = held_out(train).select(*names, "y", "late", "date_idx", "inst_ord")
    rows = rows.repartition(workers, "date_idx", "inst_ord").sortWithinPartitions("date_idx", "inst_ord").persist()
    net = Network((len(names), *hidden, 1))
    state = Adam(net.w, np.zeros_like(net.w), np.zeros_like(net.w))
    size = len(net.w)

    def one_pass(number: int, state: Adam):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            t = pa.Table.from_batches(held) if held else None
            if t is None or not t.num_rows:
                return
            late = t.column("late").to_numpy()
            x, y = np.stack([t.column(c).to_numpy() for c in names], 1), t.column("y").to_numpy()
            loss = ((Network(net.sizes, state.w).predict(x[late]) - y[late]) ** 2).sum() if late.any() else 0.0
            x, y = x[~late], y[~late]
            # its own draws for each pass and part of the rows, the same when a task is run again
            rng = np.random.default_rng([seed, number, int(t.column("date_idx")[0].as_py()), int(t.column("inst_ord")[0].as_py())])
            own = Adam(state.w, state.m, state.v, state.steps)
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                i = order[at : at + batch]
                own.step(net.gradient(own.w, x[i], y[i], dropout, rng), rate)
            n = float(len(y))
            sums = np.concatenate([own.w * n, own.m * n, own.v * n, [own.steps * n, n, loss, float(late.sum())]])
            yield pa.record_batch([pa.array([sums], pa.list_(pa.float64()))], ["s"])

        return run

    best, bad, losses, kept = np.inf, 0, [], net.w
    try:
        for number in range(passes + 1):
            sums = rows.mapInArrow(one_pass(number, state), "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
            total = np.zeros(3 * size + 4)
            for r in sums.collect():
                total[r.i] = r.v
            steps, n, loss, late = total[-4:]
            if not n:
                break
            if number:  # the weights that this pass began with
                losses.append(loss / max(late, 1))
                if losses[-1] < best - BETTER:
                    best, bad, kept = losses[-1], 0, state.w
                else:
                    bad += 1
                    if bad >= patience:
                        break
            w, m, v = (total[i * size : (i + 1) * size] / n for i in range(3))
            state = Adam(w, m, v, steps / n)
    finally:
        rows.unpersist()
    return Network(net.sizes, kept), losses
