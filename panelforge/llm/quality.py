"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import as_bytes, crc_mod, table, written

#: Bytes counted as odd symbols and as ordinary punctuation.
SYMBOLS = np.frombuffer(b"#$%&*!|<>{}[]=+~^\\/_@", np.uint8)
PUNCTUATION = np.frombuffer(b".,;:?'\"()-", np.uint8)

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "punctuation", "distinct_words", "distinct_pairs",
    "distinct_lines", "line_length", "packed", "short_words", "letters", "word_length_sd",
)


def _share(part: float, whole: float) -> float:
    """log-odds of a share, with half a count on each side."""
    return math.log((part + 0.5) / (max(whole - part, 0.0) + 0.5))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text; those of an empty one are finite, too."""
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    n, w = len(text), len(words)
    lengths = np.fromiter(map(len, words), np.float64, w) if w else np.zeros(1)
    upper, lower, digits, wide = h[65:91].sum(), h[97:123].sum(), h[48:58].sum(), h[128:].sum()
    letters = upper + lower + wide
    packed = len(zlib.compress(text, 1))
    return [
        math.log1p(w),
        math.log1p(float(lengths.mean())),
        _share(upper, letters),
        _share(digits, n),
        _share(h[SYMBOLS].sum(), n),
        _share(h[PUNCTUATION].sum(), n),
        _share(len(set(words)), w) / max(1.0, math.log1p(w)),
        _share(len(set(zip(words, words[1:]))), max(w - 1, 0)) / max(1.0, math.log1p(w)),
        _share(len(set(lines)), len(lines)),
        math.log1p(w / len(lines)),
        math.log((packed + 20.0) / (n + 20.0)),
        _share((lengths <= 3).sum() if w else 0, w),
        _share(letters, n),
        math.log1p(float(lengths.std())),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the array of statistics of each whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch(
                [b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"]
            )

    return docs.select("doc_id", as_bytes(text).alias("b")).mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Gaussian class densities with shrunken covariances; keeps a Cholesky factor per class."""

    def __init__(self, n, mean, cov, shrink: float = 0.1):
        total = sum(n)
        pooled = sum(k * c for k, c in zip(n, cov)) / total
        scale = np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
        self.mean, self.factor, self.const = mean, [], []
        for k, c in zip(n, cov):
            s = (1 - shrink) * ((1 - shrink) * c + shrink * pooled) + shrink * scale
            low = np.linalg.cholesky(s)
            self.factor.append(np.linalg.inv(low))
            self.const.append(math.log(k / total) - np.log(np.diag(low)).sum())

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1, prior included, less that of class 0."""
        d = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.mean, self.factor, self.const)]
        return d[1] - d[0]


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.1) -> Discriminant | None:
    """Class means and covariances from sums that Spark adds up; only (features^2) numbers reach the driver.

    ``stats``: doc_id, x; ``labels``: doc_id, quality. Several labels of a document count as their
    largest. None if one of the classes has fewer than two documents.
    """
    d = len(FEATURES)
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = np.asarray(b.column(0))
            x = np.asarray(b.column(1).flatten()).reshape(-1, d)
            for k in (0, 1):
                z = x[y == k]
                v = np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
                yield pa.record_batch([pa.array([k] * len(v)), pa.array(range(len(v))), pa.array(v)], ["k", "i", "v"])

    rows = (
        stats.join(own, "doc_id").select("quality", "x").mapInArrow(sums, "k long, i long, v double")
        .groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    )
    v = np.zeros((2, 1 + d + d * d))
    for r in rows:
        v[r.k, r.i] = r.v
    if v[:, 0].min() < 2:
        return None
    mean = [s[1 : 1 + d] / s[0] for s in v]
    cov = [s[1 + d :].reshape(d, d) / s[0] - np.outer(m, m) for s, m in zip(v, mean)]
    return Discriminant(v[:, 0], mean, cov, shrink)


def quality_scores(docs: DataFrame, labels: DataFrame, shrink: float = 0.1) -> DataFrame:
    """doc_id, score (0 to 1; higher: label 1 likelier) of every row of ``docs``.

    All of ``labels`` is learnt from. Nulls and empty texts get the score of an empty text's statistics,
    repeated rows one score each, an empty table no rows; with too few labels to learn from, every score
    is 1 (nothing is rejected). Other columns of ``docs`` are not read.
    """
    stats = written(with_statistics(docs))
    model = fit(stats, labels, shrink)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(FEATURES))
            s = np.ones(len(x)) if model is None else 1 / (1 + np.exp(-np.clip(model.margin(x), -500, 500)))
            yield pa.record_batch([b.column(0), pa.array(s)], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(crc_mod("doc_id", 3) != 1)
    return quality_scores(docs, labels).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
