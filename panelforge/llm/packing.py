"""Best-fit packing of tokenised documents into sequences of fixed capacity by large-item matching."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import table, written

CAPACITY, END_ID = 4096, 1
#: Rows of a bucket in which the rows of one length are numbered, so that a frequent length is no single task.
BUCKET_ROWS = 100_000


#: Texts of these characters and without special strings are split here, others by the tokenizer itself.
PLAIN = re.compile(r"(?!.*<\|(?:start|end)oftext\|>)[\t\n\r -~\u00a0-\u012f\u0131-\u017f]*", re.S)
#: The tokenizer's own split of lower-cased text, for the characters of PLAIN.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")


class WordTokens:
    """Token ids of a text as little-endian bytes, put together from the ids of its words.

    The tokenizer lower-cases, drops white space and never joins what its split keeps apart, so a text's
    ids are its words' ids in order. Words are remembered up to a bound; only new ones are encoded.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        kind["normalizer"] = None
        kind["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.part, self.most = Tokenizer.from_str(json.dumps(kind)), most
        self.words: dict[str, bytes] = {"": b""}  # between spaces, as written
        self.parts: dict[str, bytes] = {}  # as the tokenizer splits them

    def __call__(self, text: str) -> bytes:
        flat = text.replace("\n", " ")
        # printable ASCII without special strings is plain; other texts are looked at letter by letter
        if not (flat.isascii() and flat.isprintable() and "oftext|>" not in flat) and not PLAIN.fullmatch(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = flat.split(" ")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._learn({w for w in words if w not in self.words}, words)
            return b"".join(map(self.words.__getitem__, words))

    def _learn(self, new: set[str], words: list[str]) -> None:
        if len(self.words) > self.most:
            self.words = {"": b""}
            new = set(words)
        if len(self.parts) > self.most:
            self.parts = {}
        split = {w: SPLIT.findall(w.lower()) for w in new}
        unknown = list({p for ps in split.values() for p in ps if p not in self.parts})
        for p, e in zip(unknown, self.part.encode_batch_fast(unknown, add_special_tokens=False)):
            self.parts[p] = np.asarray(e.ids, "<u4").tobytes()
        for w, ps in split.items():
            self.words[w] = self.parts[ps[0]] if len(ps) == 1 else b"".join(map(self.parts.__getitem__, ps))


_tokens: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty and still has its end id; repeated rows each give their own pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokens:
            _tokens[tokenizer_path] = WordTokens(tokenizer_path)
        ids = _tokens[tokenizer_path]
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """How many items of each length go together, and how many bins that takes.

    Items of one length are alike, so whole runs of bins are filled at once and the work is bounded by
    the number of lengths, not of items. Items above a third of the capacity meet at most twice in a
    bin: the longest takes the longest such partner that still fits. The others then go, longest first,
    to the fullest bin that can take them. Rows: (length, first, last + 1, bin of the first, offset);
    the items ``first`` to ``last`` of that length go one each to consecutive bins.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space: runs of bins (first, how many)
    bins = 0

    def put(size: int, n: int, first: int, offset: int) -> None:
        rows.append((size, taken[size], taken[size] + n, first, offset))
        taken[size] += n
        left[size] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for i, size in enumerate(large):
        j = i
        while left[size]:
            while j < len(large) and (not left[large[j]] or size + large[j] > capacity or (large[j] == size and left[size] < 2)):
                j += 1
            mate = large[j] if j < len(large) else 0
            if mate == size:
                n = left[size] // 2
                put(size, n, bins, 0)
                put(size, n, bins, size)
            elif mate:
                n = min(left[size], left[mate])
                put(size, n, bins, 0)
                put(mate, n, bins, size)
            else:
                n = left[size]
                put(size, n, bins, 0)
            gaps.setdefault(capacity - size - mate, []).append((bins, n))
            bins += n
    free = sorted(gaps)
    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[size]:
            k = np.searchsorted(free, size)  # the tightest gap that fits
            if k < len(free):
                gap = free[k]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], free[k]
                n = min(many, left[size])
                if n < many:
                    if gap not in gaps:
                        free.insert(int(np.searchsorted(free, gap)), gap)
                    gaps.setdefault(gap, []).append((first + n, many - n))
            else:
                gap, n, first = capacity, max(1, left[size] // (capacity // size)), bins
                bins += n
            put(size, n, first, capacity - gap)
            if rest := gap - size:
                if rest not in gaps:
                    free.insert(int(np.searchsorted(free, rest)), rest)
                gaps.setdefault(rest, []).append((first, n))
    return rows, bins


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (any columns, with ``length`` from 1 to ``capacity``) and their sequence_id and offset.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver; the plan made of it is
    of the same order. Rows of a length are numbered within buckets, dealt by the hash of column __row
    where there is one and else of the whole row, whose number grows with the rows; running sums over a length's
    buckets give each its start, so no length is gathered in one task. ``items`` should be a stored table: it is
    read twice. An empty table gives no rows; column names that start with __ are left to this function.
    """
    total = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(64, -(-sum(total.values()) // BUCKET_ROWS))
    of = F.xxhash64("__row") if "__row" in items.columns else F.xxhash64(*items.columns)
    keyed = items.withColumn("__b", F.pmod(of, F.lit(buckets)))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("__b"))
    starts = keyed.groupBy("length", "__b").agg(F.count("*").alias("n")).select("length", "__b", (upto - F.col("n")).alias("__from"))
    order = [c for c in ("doc_id", "piece", "__row") if c in items.columns]
    ranked = (
        keyed.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__b").orderBy(*order)))
        .join(starts, ["length", "__b"])
        .withColumn("__k", (F.col("__from") + F.col("__r") - 1).cast("long"))
    )
    rows, _ = plan(total, capacity)
    runs = np.array(sorted(rows), np.int64).reshape(-1, 5)
    sent = items.sparkSession.sparkContext.broadcast(runs)
    kept = [c for c in items.columns if c != "__row"]
    out = T.StructType([*(items.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, _, first, at = sent.value.T
        keys = (size << 44) | low
        for b in batches:
            k = b.column("__k").to_numpy()
            i = np.searchsorted(keys, (b.column("length").to_numpy().astype(np.int64) << 44) | k, "right") - 1
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(first[i] + k - low[i]), pa.array(at[i])], [*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "__k").mapInArrow(placed, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the sequence and the place in it that each goes to.

    Defined for null texts (one piece, the end id), texts of any length, repeated rows and empty tables;
    columns of ``docs`` other than doc_id and text are not read.
    """
    return pack(written(pieces(docs, tokenizer_path, capacity).withColumn("__row", F.monotonically_increasing_id())), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
