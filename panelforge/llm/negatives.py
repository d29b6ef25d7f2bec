"""Hard negatives of anchors, by bounds that spread over a spanning tree of the anchors.

An anchor's score with a candidate differs from its parent's by the inner product of the edge with the candidate, so
by no more than the edge's length times the candidate's norm. Walking the tree from its root, whose parent is the
origin with scores of 0, every candidate has an interval for its score; only candidates whose interval meets
the window that is looked for are scored, and their interval shrinks to a point for the anchors below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import grouped, running, scratch, table, written

#: Anchors of a block (one tree), candidates that are scored at a time, and rows of a group of them that one task takes at most.
ANCHORS, CHUNK, GROUP = 4_096, 8_192, 1 << 20
#: Directions whose signs order the anchors, so that those of a block are near each other.
SIGNS = 24


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; beyond +-sqrt(2^53 / length) that bound, so that inner products are exact in a double."""
    limit = F.floor(F.sqrt(F.lit(2.0**53) / F.greatest(F.size(vector), F.lit(1))))
    return F.transform(vector, lambda x: F.floor(F.greatest(-limit, F.least(limit, x.cast("double") * factor))).cast("int"))


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows of ``rows`` (vec_id, label, embedding) that have all of them and finite components only.

    Of rows that repeat a vec_id the one of least label, and then least vector, stays.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ok = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    one = ok.select("vec_id", F.struct(F.col("label").cast("long").alias("label"), scaled(F.col("embedding")).alias("v")).alias("r"))
    return one.groupBy("vec_id").agg(F.min("r").alias("r")).select(F.col("vec_id").cast("long").alias("vec_id"), "r.label", "r.v")


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers as doubles; shorter ones are filled with zeros."""
    arrays = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64), arrays.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.hstack([x, np.zeros((len(x), width - x.shape[1]))])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = matrix(b.column("v"))
        planes = np.random.default_rng(11).standard_normal((SIGNS, x.shape[1])) if x.shape[1] else np.zeros((SIGNS, 0))
        code = ((x @ planes.T > 0) @ (1 << np.arange(SIGNS, dtype=np.int64))).astype(np.int64)
        yield pa.record_batch([*(b.column(c) for c in ("vec_id", "label", "v")), pa.array(code)], ["vec_id", "label", "v", "code"])


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, parent): a minimum spanning tree of the rows as their order, parents first, and the place in it of each one's parent (-1: the root's).

    The heaviest child comes last, so that a walk in this order has few nodes open at a time.
    """
    n = len(x)
    square = np.einsum("ij,ij->i", x, x)
    least, by, free = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at, found = int(square.argmin()), []
    for _ in range(n):
        free[at] = False
        found.append(at)
        d = np.where(free, square + square[at] - 2 * (x @ x[at]), np.inf)
        nearer = d < least
        least[nearer], by[nearer] = d[nearer], at
        at = int(np.where(free, least, np.inf).argmin())
    weight, children = np.ones(n, np.int64), [[] for _ in range(n)]
    for i in reversed(found[1:]):
        weight[by[i]] += weight[i]
        children[by[i]].append(i)
    order, stack = [], [found[0]]
    while stack:
        order.append(stack.pop())
        stack += sorted(children[order[-1]], key=lambda c: -weight[c])  # the lightest is taken first
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return np.asarray(order), np.array([place[by[i]] if by[i] >= 0 else -1 for i in order])


def _planted(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The tree of one block of anchors, as one row of arrays."""
    x = matrix(t.column("v"))
    order, parent = spanning_tree(x)
    ids, labels = (t.column(c).to_numpy()[order] for c in ("vec_id", "label"))
    one = lambda a, kind: pa.array([a], pa.list_(kind))
    columns = [pa.array([t.column("block")[0].as_py()], pa.int64()), one(ids, pa.int64()), one(labels, pa.int64()), one(parent, pa.int64()), one(x[order].astype(np.int32).ravel(), pa.int32())]
    yield pa.record_batch(columns, ["block", "ids", "labels", "parents", "x"])


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, ties by smaller id, in order."""
    if len(scores) > 4 * k:
        enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[enough], ids[enough]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Walk:
    """Walks of a block's tree over chunks of candidates. ``scored`` counts the inner products that were needed."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, parents: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.parents, self.x, self.scored = ids, labels, parents, x, 0
        above = np.where(parents[:, None] >= 0, x[parents], 0.0)
        # a little more than they are, as bounds are rounded
        self.edges, self.norms = (np.sqrt(np.einsum("ij,ij->i", y, y)) * (1 + 1e-9) for y in (x - above, x))
        self.last = {int(p): i for i, p in enumerate(parents)}

    def over(self, y: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        """``y``, sorted by label: the chunk."""
        width = max(y.shape[1], self.x.shape[1])
        self.x, y = widened(self.x, width), widened(y, width)
        norm = np.sqrt(np.einsum("ij,ij->i", y, y)) * (1 + 1e-9)
        starts, ends = np.searchsorted(labels, self.labels), np.searchsorted(labels, self.labels, "right")
        live: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, p in enumerate(self.parents):
            most = self.norms[i] * norm + 1e-3
            low, high = -most, most
            if p >= 0:
                far = self.edges[i] * norm + 1e-3
                low, high = np.maximum(low, live[p][0] - far), np.minimum(high, live[p][1] + far)
                if self.last[p] == i:
                    del live[p]
            need = self.needed(i, low, high, starts[i], ends[i])
            if len(need):
                self.scored += len(need)
                if 4 * len(need) > len(y):  # the whole product costs less than picking the rows
                    low = high = y @ self.x[i]
                    scores = low[need]
                else:
                    scores = low[need] = high[need] = y[need] @ self.x[i]
                self.take(i, scores.astype(np.int64), ids[need])
            if i in self.last:
                live[i] = low, high


class Positives(Walk):
    """Each anchor's ``k`` best of its label, itself left out."""

    def __init__(self, *tree: np.ndarray, k: int):
        super().__init__(*tree)
        self.k, self.best = k, [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.ids)

    def needed(self, i: int, low: np.ndarray, high: np.ndarray, start: int, end: int) -> np.ndarray:
        scores, own = self.best[i][0], low[start:end]
        least = scores[-1] if len(scores) == self.k else -np.inf
        if len(own) > self.k:  # so many have at least this score, the anchor's own row left out
            least = max(least, np.partition(own, len(own) - self.k - 1)[len(own) - self.k - 1])
        return start + np.flatnonzero(high[start:end] >= least)

    def take(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.ids[i]
        had = self.best[i]
        self.best[i] = top(np.concatenate([had[0], scores[other]]), np.concatenate([had[1], ids[other]]), self.k)

    def found(self) -> Iterator[tuple]:
        """(anchor, score, id)"""
        for a, (scores, ids) in zip(self.ids.tolist(), self.best):
            yield from ((a, s, v) for s, v in zip(scores.tolist(), ids.tolist()))


class Negatives(Walk):
    """The ``k`` best of other labels within each window of an anchor: from ``share[0]`` to ``share[1]`` hundredths of a positive's score."""

    def __init__(self, *tree: np.ndarray, wanted: dict[int, list[int]], k: int, share: tuple[int, int]):
        super().__init__(*tree)
        self.k, self.windows = k, []
        for a in self.ids.tolist():
            each = {s: (-(-share[0] * s // 100), share[1] * s // 100) for s in wanted.get(a, ())}
            self.windows.append({s: w for s, w in each.items() if w[0] <= w[1]})
        none = np.empty(0, np.int64)
        self.best = [dict.fromkeys(w, (none, none)) for w in self.windows]

    def needed(self, i: int, low: np.ndarray, high: np.ndarray, start: int, end: int) -> np.ndarray:
        if not self.windows[i]:
            return np.empty(0, np.int64)
        # of a window that is full, only what reaches its worst
        least = min(self.best[i][s][0][-1] if len(self.best[i][s][0]) == self.k else w[0] for s, w in self.windows[i].items())
        meets = (high >= least) & (low <= max(w[1] for w in self.windows[i].values()))
        meets[start:end] = False
        return np.flatnonzero(meets)

    def take(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for s, (low, high) in self.windows[i].items():
            inside = (scores >= low) & (scores <= high)
            had = self.best[i][s]
            self.best[i][s] = top(np.concatenate([had[0], scores[inside]]), np.concatenate([had[1], ids[inside]]), self.k)

    def found(self) -> Iterator[tuple]:
        """(anchor, positive's score, score, id)"""
        for a, best in zip(self.ids.tolist(), self.best):
            for s, (scores, ids) in best.items():
                yield from ((a, s, n, v) for n, v in zip(scores.tolist(), ids.tolist()))


def _walked(batches: Iterator[pa.RecordBatch], planted, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Results of each block's tree and group: takes the tree's row and then the candidates by label, and holds one chunk of these.

    ``planted(row)`` gives the walk of a tree's row.
    """
    walk, key, held, n = None, None, [], 0

    def flushed() -> None:
        nonlocal held, n
        if n:
            t = pa.Table.from_batches(held)
            label = t.column("label").to_numpy()
            walk.over(matrix(t.column("v")), label, t.column("vec_id").to_numpy())
        held, n = [], 0

    def results() -> Iterator[pa.RecordBatch]:
        flushed()
        rows = list(walk.found()) if walk else []
        for at in range(0, len(rows), 50_000):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 50_000])], schema=schema)

    for b in batches:
        trees = np.flatnonzero(b.column("ids").is_valid().to_numpy(zero_copy_only=False))
        at = 0
        for start in [*trees.tolist(), b.num_rows]:
            while at < start:
                m = min(start - at, CHUNK - n)
                held.append(b.select(["vec_id", "label", "v"]).slice(at, m))
                at, n = at + m, n + m
                if n == CHUNK:
                    flushed()
            if start < b.num_rows:
                yield from results()
                walk = planted(b.slice(start, 1).to_pylist()[0])
                at = start + 1
    yield from results()


def _tree_of(row: dict) -> tuple[np.ndarray, ...]:
    ids, labels, parents = (np.asarray(row[c], np.int64) for c in ("ids", "labels", "parents"))
    return ids, labels, parents, np.asarray(row["x"], np.float64).reshape(len(ids), -1)


def _met(rows: DataFrame, trees: DataFrame, blocks: int, groups: int, planted, columns: tuple[str, ...]) -> DataFrame:
    """Every block's tree taken over every group of candidates. Trees are sent to all groups and candidates to all blocks: the
    anchors are a stated query set against all rows, in blocks."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = rows.select(every(blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("g"), "vec_id", "label", "v")
    both = candidates.unionByName(trees.select("*", every(groups).alias("g")), allowMissingColumns=True)
    dealt = both.repartition(min(2 * blocks * groups, 20_000), "block", "g").sortWithinPartitions("block", "g", F.col("ids").isNull(), "label")
    schema = pa.schema([(c, pa.int64()) for c in columns])
    return dealt.drop("block", "g").mapInArrow(lambda b: _walked(b, planted, schema), ", ".join(f"{c} long" for c in columns))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), anchors_in_block: int = ANCHORS, rows_in_group: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, embedding. An anchor's positives are the ``positives`` other rows of its label with the highest
    inner products of scaled vectors; of each, the negatives are the first rows of another label whose score is from
    ``share[0]`` to ``share[1]`` hundredths of the positive's; ties go to smaller ids. Exact.

    Rows without id, label or vector, or with a component that is null or not finite, take no part, and of
    repeated ids one row does; shorter vectors count as filled with zeros; empty tables give none; other columns
    aren't read. Blocks and groups are sized by the rows; hot labels and equal vectors don't matter to how rows are
    dealt. A task holds one tree and one chunk of candidates.
    """
    with scratch(rows.sparkSession):
        rows = written(prepared(rows))
        n = rows.count()
        anchors = rows.where(is_anchor).mapInArrow(_coded, "vec_id long, label long, v array<int>, code long")
        placed = running(anchors, [F.col("code"), F.col("vec_id")], F.lit(1).cast("long"), "at").withColumn("block", F.floor(F.col("at") / anchors_in_block))
        trees = written(grouped(placed.select("block", "vec_id", "label", "v"), ["block"], "block long, ids array<long>, labels array<long>, parents array<long>, x array<int>", _planted))
        blocks = trees.count()
        out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        if not blocks:
            return rows.sparkSession.createDataFrame([], out)
        groups = min(-(-n // rows_in_group), max(64, -(-n // GROUP)))
        first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
        best = _met(rows, trees, blocks, groups, lambda r: Positives(*_tree_of(r), k=positives), ("anchor_id", "score", "vec_id"))
        best = written(best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives))
        of_block = trees.select("block", F.explode("ids").alias("anchor_id")).join(best.select("anchor_id", "score").distinct(), "anchor_id")
        windows = of_block.groupBy("block").agg(F.collect_list("anchor_id").alias("w_ids"), F.collect_list("score").alias("w_scores"))

        def planted(r: dict) -> Negatives:
            wanted: dict[int, list[int]] = {}
            for a, s in zip(r["w_ids"] or (), r["w_scores"] or ()):
                wanted.setdefault(a, []).append(s)
            return Negatives(*_tree_of(r), wanted=wanted, k=negatives, share=share)

        hard = _met(rows, written(trees.join(windows, "block", "left")), blocks, groups, planted, ("anchor_id", "score", "negative_score", "negative_id"))
        last = Window.partitionBy("anchor_id", "score").orderBy(F.desc("negative_score"), "negative_id")
        hard = hard.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
        met = best.withColumnRenamed("vec_id", "positive_id").join(hard, ["anchor_id", "score"])
        return written(met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score"), result=True)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


SQL = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
    from e a join e c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank,
    vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 3"""
