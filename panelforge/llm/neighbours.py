"""Approximate nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import table

#: Trees, bits of a hash string, bits of the shortest prefix that counts, share of a segment's vectors to compare exactly
#: and their least number, rows of a segment, queries of a block. Vectors without any structure need a large share.
TREES, BITS, SHORTEST, SHARE, LEAST, SEGMENT, BLOCK = 160, 16, 2, 0.25, 256, 8_192, 1_024


class Forest:
    """The sorted hash strings of one segment's distinct vectors, in several trees.

    A bit of a string is the side of a random hyperplane through the segment's mean. Equal vectors are
    kept once, with the ``k`` + 1 smallest of their ids: no more of them can be among a query's nearest.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.lexsort((ids,))
        self.x, at = np.unique(x[order], axis=0, return_inverse=True)
        self.ids: list[list[int]] = [[] for _ in self.x]
        for i, j in zip(ids[order].tolist(), at.ravel().tolist()):
            if len(self.ids[j]) <= k:
                self.ids[j].append(i)
        self.k = k
        self.mean = self.x.mean(0)
        self.planes = np.random.default_rng(20).standard_normal((x.shape[1], TREES * BITS))
        codes = self.codes(self.x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.planes > 0).reshape(len(x), TREES, BITS)
        return (bits @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))).T.astype(np.uint64)

    def nearest(self, queries: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, float, int]]:
        """(place of the query, distance, id) of the nearest candidates of each query, at most ``k`` each.

        Descent finds, in every tree, the range of strings that share each length of prefix with the
        query's, down to the longest. The ascent goes up one bit in all trees at a time and credits the
        vectors of a range with 2 to the power of its prefix. Those with most credit are compared exactly.
        """
        n = len(self.x)
        want = min(n, max(LEAST, 4 * self.k, int(np.ceil(SHARE * n))))
        codes = self.codes(queries)
        ranges = np.empty((BITS + 1 - SHORTEST, TREES, len(queries), 2), np.int32)
        for t in range(TREES):
            for level in range(SHORTEST, BITS + 1):
                tail = np.uint64((1 << (BITS - level)) - 1)
                ranges[level - SHORTEST, t, :, 0] = np.searchsorted(self.sorted[t], codes[t] & ~tail)
                ranges[level - SHORTEST, t, :, 1] = np.searchsorted(self.sorted[t], codes[t] | tail, "right")
        base = (np.arange(TREES) * n)[:, None]
        order = self.order.ravel()
        for q in range(len(queries)):
            credit = np.zeros(n, np.float32)
            for level in range(BITS, SHORTEST - 1, -1):
                low, high = (ranges[level - SHORTEST, :, q] + base).T
                size = high - low
                if total := int(size.sum()):
                    at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
                    credit += np.bincount(order[at], minlength=n).astype(np.float32) * np.float32(1 << level)
            at = np.argpartition(-credit, want - 1)[:want] if want < n else np.arange(n)
            d = np.sqrt(((self.x[at] - queries[q]) ** 2).sum(1))
            keep = np.flatnonzero(d <= np.partition(d, self.k)[self.k]) if len(d) > self.k + 1 else np.arange(len(d))
            best = sorted((float(d[i]), v) for i in keep for v in self.ids[at[i]] if v != own[q])[: self.k]
            for dist, v in best:
                yield q, dist, v


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with an id and a usable vector: finite, not null, not zero, of the most frequent length."""
    v = F.col(column)
    ok = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    length = ok.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return ok.where(F.size(v) == (length.d if length else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query among all vectors but its own id.

    Both inputs: vec_id, v (see ``valid``). Every partition indexes its own rows in segments of bounded
    size, so the index needs no shuffle, equal vectors make no hot task, and a lost partition is simply
    indexed again. Queries are sent to all partitions in blocks of bounded size; only each partition's
    ``k`` best of each query are shuffled. Empty tables give no rows; of rows that repeat an id each counts.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))

    def one(block: int) -> DataFrame:
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).dropDuplicates(["vec_id"]).collect()
        ids = np.array([r.vec_id for r in rows], np.int64)
        sent = spark.sparkContext.broadcast((ids, np.array([r.v for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, q = sent.value
            held: list[pa.RecordBatch] = []
            best: dict[int, list[tuple[float, int]]] = {}

            def search() -> None:
                t = pa.Table.from_batches(held)
                x = t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
                for i, dist, v in Forest(t.column(0).to_numpy(), x, k).nearest(q, query_ids):
                    best.setdefault(i, []).append((dist, v))
                for i, found in best.items():
                    best[i] = sorted(found)[:k]

            if len(q):
                for b in batches:
                    for at in range(0, b.num_rows, SEGMENT):
                        held.append(b.slice(at, SEGMENT))
                        if sum(x.num_rows for x in held) >= SEGMENT:
                            search()
                            held = []
                if held:
                    search()
            out = [(int(query_ids[i]), v, dist) for i, found in best.items() for dist, v in found]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))],
                ["query_id", "vec_id", "score"],
            )

        return vectors.mapInArrow(run, "query_id long, vec_id long, score double")

    found = reduce(DataFrame.unionAll, (one(i) for i in range(blocks)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = valid(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
