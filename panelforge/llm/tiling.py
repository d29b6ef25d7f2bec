"""Benchmark decontamination by greedy string tiling of documents with test items."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import WordHasher, grams, table

#: Words of the shortest tile, share of an item's words that tiles must cover, words of a block of items.
MIN_MATCH, MIN_COVERAGE, BLOCK_WORDS = 5, 0.5, 1_000_000
#: Equal runs that are looked at together.
PAIRS = 1_000_000

_word = re.compile(r"[^\W_]+")
FOUND = "doc_id long, item_id long, coverage double, n_tiles int, first_word long, last_word long"


def greedy(runs: list[tuple[int, int, int]], n_doc: int, n_item: int, k: int) -> list[tuple[int, int, int]]:
    """Non-overlapping parts (place in doc, place in item, length) of maximal common runs, longest first.

    The longest run is marked, the first in doc and then in item among equals; a run that marked tokens cut
    goes back with each part of it that is left and has ``k`` tokens.
    """
    heap = [(-n, d, i) for d, i, n in runs]
    heapq.heapify(heap)
    used_d, used_i, out = np.zeros(n_doc, bool), np.zeros(n_item, bool), []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -int(n)
        taken = used_d[d : d + n] | used_i[i : i + n]
        if not taken.any():
            used_d[d : d + n] = used_i[i : i + n] = True
            out.append((d, i, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= k:
                heapq.heappush(heap, (-int(b - a), d + int(a), i + int(a)))
    return out


def runs_of(doc: np.ndarray, item: np.ndarray, at: np.ndarray, on: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which common runs of ``k`` tokens (at, on) begin and which end a maximal common run, as keys (diagonal, place in doc)."""
    first = (at == 0) | (on == 0) | (doc[at - 1] != item[on - 1])
    a, i = at + k, on + k
    last = (a == len(doc)) | (i == len(item)) | (doc[np.minimum(a, len(doc) - 1)] != item[np.minimum(i, len(item) - 1)])
    return np.stack([at - on, at], 1)[first], np.stack([at - on, a], 1)[last]


def joined_runs(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs (place in doc, place in item, length): on a diagonal, starts and ends take turns."""
    first, last = first[np.lexsort(first.T[::-1])], last[np.lexsort(last.T[::-1])]
    return list(zip(first[:, 1].tolist(), (first[:, 1] - first[:, 0]).tolist(), (last[:, 1] - first[:, 1]).tolist()))


def tiles(doc: np.ndarray, item: np.ndarray, at: np.ndarray, on: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The tiles of ``greedy`` from all places (at, on) of common runs of ``k`` tokens, found by equal running Karp-Rabin hashes."""
    return greedy(joined_runs(*runs_of(doc, item, at, on, k)), len(doc), len(item), k)


class Seeds:
    """The runs of ``k`` words of some items, sorted by hash."""

    def __init__(self, k: int, items: list[tuple[int, np.ndarray]]):
        g = [grams(h, k) for _, h in items]
        self.k = k
        seeds = np.concatenate(g)
        owner, place = np.repeat([i for i, _ in items], [len(x) for x in g]), np.concatenate([np.arange(len(x)) for x in g])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]

    def met(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place in it, place in ``h``) of all equal runs, PAIRS or a little more at a time."""
        g = grams(h, self.k)
        if not len(g):
            return
        lo = np.searchsorted(self.seeds, g)
        hit = np.flatnonzero(self.seeds[np.minimum(lo, len(self.seeds) - 1)] == g)
        if not len(hit):
            return
        lo, n = lo[hit], np.searchsorted(self.seeds, g[hit], "right") - lo[hit]
        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
            m = n[part]
            j = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            yield self.owner[j], self.place[j], np.repeat(hit[part], m)


class Items:
    """A block of test items: their words, and sorted indexes of their runs of ``k`` words (of a shorter item: all its words)."""

    def __init__(self, rows: list[tuple[int, str]], k: int):
        hasher = WordHasher()
        self.ids, self.words = [], []
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in rows:
            h = hasher(_word.findall(text.lower()))
            if len(h):
                by_size.setdefault(min(k, len(h)), []).append((len(self.ids), h))
                self.ids.append(item)
                self.words.append(h)
        self.seeds = [Seeds(size, items) for size, items in by_size.items()]

    def found(self, h: np.ndarray, least: float) -> Iterator[tuple[int, float, int, int, int]]:
        """Items covered by the words ``h`` to at least the share ``least``.

        Equal runs are looked at PAIRS at a time; what is kept of them is where maximal runs begin and end.
        """
        for s in self.seeds:
            ends: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            reach: dict[int, np.ndarray] = {}
            for owner, on, at in s.met(h):
                order = np.argsort(owner, kind="stable")
                owner, on, at = owner[order], on[order], at[order]
                for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
                    i = int(owner[part[0]])
                    item = self.words[i]
                    np.add.at(reach.setdefault(i, np.zeros(len(item) + 1, np.int64)), on[part], 1)
                    np.add.at(reach[i], on[part] + s.k, -1)
                    ends.setdefault(i, []).append(runs_of(h, item, at[part], on[part], s.k))
            for i, both in ends.items():
                # tiles lie within the equal runs, so their cover bounds the tiles'
                if (np.cumsum(reach[i])[:-1] > 0).mean() < least:
                    continue
                t = greedy(joined_runs(*(np.concatenate(x) for x in zip(*both))), len(h), len(self.words[i]), s.k)
                cover = sum(x[2] for x in t) / len(self.words[i])
                if cover >= least:
                    yield self.ids[i], cover, len(t), min(x[0] for x in t), max(x[0] + x[2] for x in t)


def contaminated(
    docs: DataFrame, items: DataFrame, k: int = MIN_MATCH, least: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document row and test item that it contains, in whatever order its parts stand.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are not read. Words are runs of
    letters and digits, lower-cased. The items are taken in hashed blocks of about ``block_words`` words,
    which bounds what is sent to the tasks; each block meets all documents, and texts are used whole.
    Null and empty texts contain nothing; of an item shorter than ``k`` words all of them must stand
    together; items without words can't be found; repeated rows each give their rows; with an empty
    table on either side there are none.
    """
    own = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    words = own.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def one(block: int) -> DataFrame:
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        sent = docs.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in rows], k))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hasher = sent.value, WordHasher()
            for b in batches:
                out = [
                    (doc, *x)
                    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                    for x in index.found(hasher(_word.findall(text.lower())), least)
                ]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)],
                    ["doc_id", "item_id", "coverage", "n_tiles", "first_word", "last_word"],
                )

        return docs.mapInArrow(run, FOUND)

    return reduce(DataFrame.unionAll, (one(i) for i in range(blocks)))


def op10_tiling(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
