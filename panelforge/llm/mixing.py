"""LM scoring by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words, each spelt byte by byte with a closing space, and then an empty word for
its end; bytes are spelt bit by bit. A bit is predicted in several contexts: the bits of its byte alone,
with the one to four bytes of the text before, be they of its word or of those before it, and with all of its word so far.
The counts behind the predictors come from all training text. A mixer adds the predictors' log-odds with weights picked by how much the longest contexts
have seen: trained online on some of it to begin with, they then take a Newton step on all training text. A map,
whose counts are of all training text, too, refines the result. Only a word's first three bytes
have words before it in their contexts, so a text is the sum of two kinds of items, each distinct one of which is scored once: what
stands at the start of a word (the four bytes before and the first three), and the rest of a word after its first three bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import U64, as_bytes, crc_mod, grouped, mix, table, written

#: log2 of the slots of each predictor: bits alone, 1, 2, 3 and 4 bytes before, the word before.
SLOTS = (8, 16, 18, 20, 20, 20)
#: Slots of a chunk of counts; bytes spelt at a time; bytes of texts that are cut into tokens at a time.
CHUNK, SLAB, TEXTS = 1 << 13, 400_000, 3_000_000
#: What stands before a text; bytes of a word whose contexts may reach before it; bytes that stand before, in an item.
START, REACH, LEAD = b"\0\0\0 ", 3, 4
#: Starts of words whose scores every task holds.
STARTS = 400_000
#: Words whose scores every task holds; items the mixer begins with; rows a counting task takes at least, and a part that the mixer is fitted on.
HEAD, TUNE, COUNT_ROWS, FIT_ROWS = 60_000, 60_000, 1_000_000, 250_000
#: The mixer's rate and tokens of a step; the predictors' prior count; buckets of the adaptive map.
RATE, STEP, PRIOR, BUCKETS = 0.1, 256, 0.4, 33

_offsets = np.concatenate([[0], np.cumsum([1 << s for s in SLOTS])])


def spelt(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The bytes that are spelt, the item of each, and each predictor's context.

    An item is a word, which gets a space after it, or else a space, the LEAD bytes that stand before, and what is spelt as it is.
    """
    led = np.fromiter((w[:1] == b" " for w in items), bool, len(items))
    all_ = np.frombuffer(b"".join(w[1:] if w[:1] == b" " else w + b" " for w in items), np.uint8)
    size = np.fromiter(map(len, items), np.int64, len(items)) + np.where(led, -1, 1)
    first = np.cumsum(size) - size
    begun = np.zeros(len(items), np.int64)  # where the word that is spelt begins: after the last space of what stands before
    for i in range(LEAD):
        begun[led & (all_[np.minimum(first + i, len(all_) - 1)] == 32)] = i + 1
    item = np.repeat(np.arange(len(items)), size)
    at = np.arange(len(all_)) - first[item]
    contexts, recent = [np.zeros(len(all_), U64)], np.zeros(len(all_), U64)
    for back in range(1, 5):
        before = np.zeros(len(all_), U64)
        before[back:] = all_[:-back]
        before[at < back] = 0
        recent |= before << U64(8 * (back - 1))
        contexts.append(recent << U64(8) if back == 1 else mix(recent + U64(back << 40)))
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, U64))
    total = np.cumsum((all_.astype(U64) + U64(1)) * power[np.maximum(at - begun[item], 0)])
    before = np.concatenate([np.zeros(1, U64), total[:-1]])  # of all bytes up to this one
    contexts.append(mix(before - before[np.minimum(first + begun, len(all_) - 1)][item] + U64(7 << 41)))
    told = at >= LEAD * led[item]
    return all_[told], item[told], [c[told] for c in contexts]


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_lower[9:14] = 32


class Tokens:
    """Texts cut into words, split at ASCII white space and lower-cased A-Z, and an end each.

    ``text``: the text of each token, in order; ``end``: whether it is an end; ``kinds``, ``word``: the distinct words, and
    which of them each token but the ends is; ``start``: what stands at each token's start (see ``start_item``) as a number;
    ``count``, ``size``: words, and bytes that are spelt, by text.
    """

    def __init__(self, texts: pa.Array):
        nul, none, blank = (pa.scalar(x, pa.binary()) for x in (START[:-1], b"", b" "))
        joined = pc.binary_join_element_wise(nul, texts.cast(pa.binary()), none, blank)
        bound = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
        data = _lower[np.frombuffer(joined.buffers()[2], np.uint8)[bound[0] : bound[-1]]]
        kept = np.ones(len(data), bool)
        kept[1:] = (data[1:] != 32) | (data[:-1] != 32)  # one space of several
        ends = np.concatenate([[0], np.cumsum(kept)])[bound - bound[0]]
        data = data[kept]
        space = np.flatnonzero(data == 32)  # a token begins after each
        self.size = np.diff(ends) - len(START) + 1
        upto = np.searchsorted(space, ends)
        self.text = np.repeat(np.arange(len(texts)), np.diff(upto))
        self.end = np.zeros(len(space), bool)
        self.end[upto[1:] - 1] = True
        self.count = np.diff(upto) - 1
        self._data, self._space = data, space
        letters = data[data != 32]
        of = np.append(space + 1 - np.arange(1, len(space) + 1), len(letters)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(space), [None, pa.py_buffer(of), pa.py_buffer(letters)])
        coded = words.filter(pa.array(~self.end)).dictionary_encode()
        self.kinds, self.word = coded.dictionary, coded.indices.to_numpy()

    @cached_property
    def start(self) -> np.ndarray:
        space, b = self._space, np.concatenate([self._data, np.full(REACH, 32, np.uint8)]).astype(U64)
        out = sum((b[space - REACH + i] << U64(8 * i) for i in range(REACH)), np.zeros(len(space), U64))
        last = np.where(self.end, U64(32), b[space + 1])
        for i in range(REACH):
            out |= last << U64(8 * (REACH + i))
            last = np.where(last == 32, last, b[np.minimum(space + 2 + i, len(b) - 1)])  # nothing is spelt after a space
        return out

    def hashes(self) -> np.ndarray:
        """64-bit hashes of all words in order, each distinct one hashed once."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.kinds.to_pylist()), U64, len(self.kinds))[self.word]


def tokens(texts: pa.Array) -> Iterator[tuple[slice, Tokens]]:
    """Runs of the texts of about TEXTS bytes, and their tokens."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    run = (np.cumsum(size) - size) // TEXTS
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), len(texts)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield slice(i, j), Tokens(texts.slice(i, j - i))


def start_item(start: int) -> bytes:
    """The item of a token's start: four bytes that stand before, and its first three, or up to its closing space."""
    b = start.to_bytes(2 * REACH, "little")
    return b" " + b[:REACH] + b" " + (b[REACH:].split(b" ")[0] + b" ")[:REACH]


def rest_item(word: bytes) -> bytes | None:
    """The item of what follows a word's first three bytes, if anything does."""
    return b"  " + word[:REACH] + word[REACH:] + b" " if len(word) >= REACH else None


def slots(contexts: list[np.ndarray], node: np.ndarray) -> Iterator[np.ndarray]:
    """Each predictor's slot, among those of all predictors, for the bit at ``node`` of each byte."""
    n = node.astype(U64)
    for k, (log, c) in enumerate(zip(SLOTS, contexts)):
        s = c + n if k < 2 else ((c + n * U64(0xC2B2AE3D27D4EB4F)) * U64(0x9FB21C651E98DF25)) >> U64(64 - log)
        yield s.astype(np.int64) + _offsets[k]


def bits(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, bit) of every byte for each of its eight bits, high bits first."""
    t = text.astype(np.int64)
    for b in range(7, -1, -1):
        yield (1 << (7 - b)) | (t >> (b + 1)), (t >> b) & 1


def slabs(words: list[bytes]) -> Iterator[slice]:
    """Runs of the items of about SLAB bytes."""
    at, size = 0, 0
    for i, w in enumerate(words):
        if size and size + len(w) > SLAB:
            yield slice(at, i)
            at, size = i, 0
        size += len(w) + 1
    if at < len(words):
        yield slice(at, len(words))


class Tables:
    """Log-odds by slot, and how much the gates' slots have seen: as they are, and for a sighting of its bit, 0 or 1, that doesn't count.

    Only the counts [slot, bit] are sent; the tables are made of them where they are first used.
    """

    def __init__(self, counts: np.ndarray):
        self.n, self.made = counts.astype(np.float32), None

    def __getstate__(self):
        return {"n": self.n, "made": None}

    def __call__(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if self.made is None:
            n0, n1 = self.n[:, 0], self.n[:, 1]
            less = [(np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))]
            odds = [np.log((b + PRIOR) / (a + PRIOR)) for a, b in ((n0, n1), *less)]
            seen = [np.minimum(np.log2(a[_offsets[4] :] + b[_offsets[4] :] + 1), 7).astype(np.int8) for a, b in ((n0, n1), *less)]
            self.made = odds[0], seen[0], np.stack(odds[1:], 1).ravel(), np.stack(seen[1:], 1).ravel()
        return self.made


class Mixer:
    """The predictors' tables, the gated weights and the adaptive map. Sent without the tables, which ``on`` gives back."""

    def __init__(self, counts: np.ndarray):
        self.tables = Tables(counts)
        self.weights = np.full((64, len(SLOTS)), 0.3, np.float32)
        centre = np.linspace(-8, 8, BUCKETS)
        self.map = np.repeat((1 / (1 + np.exp(-centre)))[None], 256, 0)

    def __getstate__(self):
        return {"weights": self.weights, "map": self.map, "tables": None}

    def on(self, tables: Tables) -> Mixer:
        self.tables = tables
        return self

    def inputs(self, contexts: list[np.ndarray], node: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each predictor, and the gate. ``held``: bits whose own sighting doesn't count."""
        odds, seen = np.empty((len(SLOTS), len(node)), np.float32), []
        table, gates = self.tables()[:2] if held is None else self.tables()[2:]
        for k, s in enumerate(slots(contexts, node)):
            at = s if held is None else 2 * s + held
            np.take(table, at, out=odds[k])
            if k >= 4:
                seen.append(gates[at - _offsets[4] * (1 if held is None else 2)].astype(np.int64))
        return odds, seen[1] * 8 + seen[0]

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        x = self.weights[gate, 0] * odds[0]
        for k in range(1, len(SLOTS)):
            x += self.weights[gate, k] * odds[k]
        return np.clip(x, -12, 12)

    def refined(self, node: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that the bit is 1, and the bucket of the map."""
        bucket = np.rint((np.clip(x, -8, 8) + 8) * ((BUCKETS - 1) / 16)).astype(np.int64)
        return 0.5 / (1 + np.exp(-x)) + 0.5 * self.map[node, bucket], bucket

    def train(self, words: list[bytes], times: list[int]) -> None:
        """One online pass: steps of STEP words, each word without its own sighting, then the map's counts."""
        ones, all_ = np.full((256, BUCKETS), 0.0), np.full((256, BUCKETS), 1e-9)
        ones += 8 * self.map
        all_ += 8
        for i in range(0, len(words), STEP):
            text, word, contexts = spelt(words[i : i + STEP])
            weight = np.asarray(times[i : i + STEP], np.float32)[word]
            for node, bit in bits(text):
                odds, gate = self.inputs(contexts, node, bit)
                x = self.mixed(odds, gate)
                _, bucket = self.refined(node, x)
                np.add.at(ones, (node, bucket), weight * bit)
                np.add.at(all_, (node, bucket), weight)
                step = (bit - 1 / (1 + np.exp(-x))) * weight * odds
                total = np.bincount(gate, weight, 64) + 16
                for k in range(len(SLOTS)):
                    self.weights[:, k] += RATE * np.bincount(gate, step[k], 64) / total
        self.map = ones / all_

    def slopes(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """By gate, the gradient of the log likelihood in the weights and its negative Hessian, summed over all tokens."""
        out = np.zeros((64, len(SLOTS), len(SLOTS) + 1))
        for part in slabs(words):
            text, word, contexts = spelt(words[part])
            weight = times[part].astype(np.float64)[word]
            for node, bit in bits(text):
                odds, gate = self.inputs(contexts, node, bit)
                p = 1 / (1 + np.exp(-self.mixed(odds, gate)))
                off, bend = (bit - p) * weight, p * (1 - p) * weight
                for k in range(len(SLOTS)):
                    out[:, k, 0] += np.bincount(gate, off * odds[k], 64)
                    bent = bend * odds[k]
                    for j in range(k + 1):
                        out[:, k, 1 + j] += np.bincount(gate, bent * odds[j], 64)
        return out.ravel()

    def step(self, slopes: np.ndarray) -> None:
        """One Newton step from the sums of ``slopes``, of 1 at most in each weight."""
        of = slopes.reshape(64, len(SLOTS), len(SLOTS) + 1)
        low = of[:, :, 1:]
        bend = low + np.tril(low, -1).transpose(0, 2, 1) + 16 * np.eye(len(SLOTS))
        self.weights += np.clip(np.linalg.solve(bend, of[:, :, :1])[:, :, 0], -1, 1).astype(np.float32)

    def shown(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """By node and bucket of the map, the ones and all bits over all tokens."""
        out = np.zeros((2, 256 * BUCKETS))
        for part in slabs(words):
            text, word, contexts = spelt(words[part])
            weight = times[part].astype(np.float64)[word]
            for node, bit in bits(text):
                x = self.mixed(*self.inputs(contexts, node, bit))
                at = node * BUCKETS + self.refined(node, x)[1]
                out[0] += np.bincount(at, weight * bit, 256 * BUCKETS)
                out[1] += np.bincount(at, weight, 256 * BUCKETS)
        return out.ravel()

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word."""
        out = np.zeros(len(words))
        for part in slabs(words):
            text, word, contexts = spelt(words[part])
            total = np.zeros(len(text))
            for node, bit in bits(text):
                p, _ = self.refined(node, self.mixed(*self.inputs(contexts, node)))
                total += np.log10(np.where(bit == 1, p, 1 - p))
            out[part] = np.bincount(word, total, part.stop - part.start)
        return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, start, item, c of every distinct word, and of every distinct start of a token, of ``docs`` (b, train).

    ``c``: how often it stands in training rows (or 0); ``item``: what the mixer spells of it, if anything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for part, t in tokens(b.column(0)):
                learnt = train[part][t.text]
                c = np.bincount(t.word, learnt[~t.end], len(t.kinds)).astype(np.int64)
                yield pa.record_batch([t.kinds, pa.nulls(len(c), pa.int64()), pa.array(c)], ["word", "start", "c"])
                starts = pa.array(t.start.view(np.int64)).dictionary_encode()
                c = np.bincount(starts.indices.to_numpy(), learnt, len(starts.dictionary)).astype(np.int64)
                yield pa.record_batch([pa.nulls(len(c), pa.binary()), starts.dictionary, pa.array(c)], ["word", "start", "c"])

    def itemised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [start_item(j) if w is None else rest_item(w) for w, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(items, pa.binary()), b.column(2)], ["word", "start", "item", "c"])

    found = docs.select("b", "train").mapInArrow(run, "word binary, start long, c long").groupBy("word", "start").agg(F.sum("c").alias("c"))
    return found.mapInArrow(itemised, "word binary, start long, item binary, c long")


def counted(words: DataFrame, ends: int) -> np.ndarray:
    """Counts [slot, bit] of all predictors over the words (word, c) and ``ends`` empty ones.

    Each task adds up its words in tables of a fixed size and passes these on in chunks, which are added
    up by chunk; so what reaches the driver is of that size, too, whatever the number of words.
    """
    size = int(_offsets[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * size, np.float64)
        first = TaskContext.get().partitionId() == 0
        for b in batches:
            w, c = b.column(0).to_pylist(), np.asarray(b.column(1))
            for part in slabs(w):
                count(n, w[part], c[part])
        if first:
            count(n, [b""], np.array([ends]))
        for at in range(0, 2 * size, 2 * CHUNK):
            v = n[at : at + 2 * CHUNK]
            if v.any():
                yield pa.record_batch([pa.array([at]), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["chunk", "v"])

    def count(n: np.ndarray, w: list[bytes], c: np.ndarray) -> None:
        text, word, contexts = spelt(w)
        weight = c[word].astype(np.float64)
        for node, bit in bits(text):
            for k, s in enumerate(slots(contexts, node)):
                at, end = 2 * _offsets[k], 2 * _offsets[k + 1]
                n[at:end] += np.bincount(2 * s + bit - at, weight, end - at)

    def add(t: pa.Table) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in t.column(1))
        yield pa.record_batch([pa.array([t.column(0)[0].as_py()]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["chunk", "v"])

    parts = grouped(words.mapInArrow(run, "chunk long, v binary"), ["chunk"], "chunk long, v binary", add)
    out = np.zeros(2 * size, np.float32)
    for r in parts.toLocalIterator():
        v = np.frombuffer(bytes(r.v), np.float32)
        out[r.chunk : r.chunk + len(v)] = v
    return out.reshape(-1, 2)


def fitted(words: DataFrame, n: int, ends: int, model: Mixer, tables: Broadcast | None = None) -> float:
    """Fit ``model`` on all tokens: ``n`` distinct words (word, c) and ``ends`` empty ones. Returns the bits its map is made of.

    Words are dealt by hash into parts of about FIT_ROWS, in the order of the hashes; a word counts as often as it stands. Sums of the
    parts are added up by chunk, in an order of their own, so that reruns agree; what reaches the driver is one sum.
    """
    spark = words.sparkSession
    tables = tables or spark.sparkContext.broadcast(model.tables)
    h = F.xxhash64("word", F.lit(3))
    all_ = words.unionByName(spark.createDataFrame([(bytearray(), ends)] if ends else [], "word binary, c long")).select("word", "c", h.alias("h"))
    dealt = all_.repartition(max(1, -(-n // FIT_ROWS)), "h").sortWithinPartitions("h", "word").select("word", "c")

    def summed(name: str, size: int) -> np.ndarray:
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                total += getattr(sent.value.on(tables.value), name)(b.column(0).to_pylist(), b.column(1).to_numpy())
            for at in range(0, size, CHUNK):
                if total[at : at + CHUNK].any():
                    yield pa.record_batch([pa.array([at]), pa.array([total[at : at + CHUNK].tobytes()], pa.binary())], ["chunk", "v"])

        def add(t: pa.Table) -> Iterator[pa.RecordBatch]:
            total = sum(np.frombuffer(x, np.float64) for x in sorted(t.column(1).to_pylist()))
            yield pa.record_batch([pa.array([t.column(0)[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["chunk", "v"])

        out = np.zeros(size)
        for r in grouped(dealt.mapInArrow(run, "chunk long, v binary"), ["chunk"], "chunk long, v binary", add).toLocalIterator():
            v = np.frombuffer(bytes(r.v), np.float64)
            out[r.chunk : r.chunk + len(v)] = v
        return out

    model.step(summed("slopes", 64 * len(SLOTS) * (len(SLOTS) + 1)))
    ones, seen = summed("shown", 2 * 256 * BUCKETS).reshape(2, 256, BUCKETS)
    centre = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))
    model.map = (8 * centre + ones) / (8 + seen)
    return float(seen.sum())


def start_ids(starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of tokens' starts."""
    return mix(starts.view(U64) + U64(0x9E3779B97F4A7C15))


def lm_scores(docs: DataFrame, train) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of ``docs``.

    ``train``: the condition under which a row is learnt from. Tokens are words split at ASCII white space
    and lower-cased A-Z, and one end. ``base_score`` is the add-one unigram log10 probability from exact
    counts, ``score`` the mixer's. A null text is empty and has its end token; repeated rows each have
    theirs; with nothing to learn from the base is 0 for any token, and the mixer knows only its priors.
    ``bits_per_byte`` is over the bytes that are coded: the lower-cased words, each with one byte to close it.

    The HEAD most frequent words and STARTS starts are looked up where the texts are; others, a small part, go to their
    scores by a shuffle on a 64-bit hash, one row for each of a text.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("b"), F.coalesce(train, F.lit(False)).alias("train"))
    found = written(vocabulary(read))
    ends = read.where("train").count()
    n, v = found.where("c > 0 and word is not null").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    known = found.where("c > 0 and item is not null").select(F.col("item").alias("word"), "c")
    all_, different = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = Mixer(counted(known.coalesce(max(1, -(-different // COUNT_ROWS))), 0))
    draw = F.floor(F.col("c") * F.lit(TUNE / max(all_, 1)) + F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    sample = known.select("word", draw.cast("int").alias("k")).where("k > 0").toArrow()
    order = sorted((xxhash.xxh3_64_intdigest(w, 3), w, k) for w, k in zip(sample.column(0).to_pylist(), sample.column(1).to_pylist()))
    model.train([w for _, w, _ in order], [k for _, _, k in order])
    tables = spark.sparkContext.broadcast(model.tables)  # once for all passes
    fitted(known, different, 0, model, tables)
    sent = spark.sparkContext.broadcast(model)
    floor = math.log10(n + v + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_pylist()
            start = b.column(1).fill_null(0).to_numpy()
            ids = np.fromiter((0 if x is None else xxhash.xxh3_64_intdigest(x) for x in w), U64, len(w))
            ids = np.where(b.column(0).is_null().to_numpy(zero_copy_only=False), start_ids(start), ids).view(np.int64)
            spelt_out = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            lm = np.zeros(len(w))
            lm[spelt_out] = sent.value.on(tables.value).score(b.column(2).drop_null().to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ids), b.column(3), pa.array(lm)], ["word", "start", "id", "c", "lm"])

    scores = written(found.mapInArrow(scored, "word binary, start long, id long, c long, lm double"))

    def most_frequent(of: DataFrame, most: int) -> DataFrame:
        """No more than ``most`` rows: those of the least count or more, which is found from counts by eighths of a power of two."""
        step = F.floor(F.log2("c") * 8)
        total, least = 0, None
        for r in sorted(of.where("c > 0").groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), reverse=True):
            total += r.n
            if total > most:
                break
            least = r.c
        return of.where(F.col("c") >= least) if least else of.limit(0)

    head = most_frequent(scores.where("word is not null"), HEAD).select("word", "c", "lm").toArrow()
    c = np.asarray(head.column(1), np.float64)
    values = np.stack([np.log10(c + 1) - floor, np.asarray(head.column(2), np.float64), (c > 0).astype(np.float64)], 1)
    starts = most_frequent(scores.where("start is not null"), STARTS).select("start", "lm").toArrow()
    order = np.argsort(np.asarray(starts.column(0), np.int64))
    held = spark.sparkContext.broadcast((
        head.column(0).to_pylist(), values, np.asarray(starts.column(0), np.int64)[order], np.asarray(starts.column(1), np.float64)[order]
    ))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values, starts, start_lm = held.value
        words, values = pa.array(words, pa.binary()), np.vstack([values, np.zeros((1, 3))])  # the last: of those not held
        starts, start_lm = np.append(starts, np.iinfo(np.int64).max), np.append(start_lm, 0.0)
        row = TaskContext.get().partitionId() << 40

        def tail(text: np.ndarray, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """text, kind, k of different pairs."""
            pair, k = np.unique(text * n + kind, return_counts=True)
            return pair // n, pair % n, k

        for b in batches:
            for part, t in tokens(b.column(1)):
                of, docs_here = t.text[~t.end], part.stop - part.start
                place = pc.index_in(t.kinds, value_set=words).fill_null(-1).to_numpy() if len(words) else np.full(len(t.kinds), -1)
                base, lm, known = (np.bincount(of, values[place, i][t.word], docs_here) for i in range(3))
                start = pa.array(t.start.view(np.int64)).dictionary_encode()
                own, which = start.dictionary.to_numpy(), start.indices.to_numpy()
                at = np.searchsorted(starts[:-1], own)
                met = starts[at] == own
                lm = lm + np.bincount(t.text, np.where(met, start_lm[at], 0.0)[which], docs_here)
                rare = place[t.word] < 0
                text1, kind1, k1 = tail(of[rare], t.word[rare].astype(np.int64), max(1, len(t.kinds)))
                ids1 = np.zeros(len(t.kinds), U64)
                few = np.flatnonzero(place < 0)
                ids1[few] = np.fromiter(map(xxhash.xxh3_64_intdigest, t.kinds.take(pa.array(few)).to_pylist()), U64, len(few))
                rare = ~met[which]
                text2, kind2, k2 = tail(t.text[rare], which[rare].astype(np.int64), max(1, len(own)))
                text, ids, k = np.concatenate([text1, text2]), np.concatenate([ids1[kind1], start_ids(own[kind2])]).view(np.int64), np.concatenate([k1, k2])
                by = np.argsort(text, kind="stable")
                pairs = pa.StructArray.from_arrays([pa.array(ids[by]), pa.array(k[by].astype(np.int64))], ["id", "k"])
                cuts = np.searchsorted(text[by], np.arange(docs_here + 1)).astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array(row + np.arange(docs_here)), b.column(0).slice(part.start, docs_here), pa.array(t.size), pa.array(np.bincount(t.text, minlength=docs_here)),
                        pa.array(known.astype(np.int64) + (ends > 0)), pa.array(base + (math.log10(ends + 1) - floor)), pa.array(lm), pa.ListArray.from_arrays(pa.array(cuts), pairs),
                    ],
                    ["row", "doc_id", "bytes", "n_tokens", "known", "base", "lm", "tail"],
                )
                row += docs_here

    sums = written(read.select("doc_id", "b").mapInArrow(
        summed, "row long, doc_id long, bytes long, n_tokens long, known long, base double, lm double, tail array<struct<id: bigint, k: bigint>>"
    ))
    word = F.col("word").isNotNull()
    of_word = scores.select(
        "id", F.when(word, F.log10(F.col("c") + 1) - floor).otherwise(0.0).alias("wb"), F.col("lm").alias("wl"), (word & (F.col("c") > 0)).cast("long").alias("wk")
    )
    rest = (
        sums.select("row", F.explode("tail").alias("t")).select("row", "t.id", "t.k").join(of_word, "id")
        .groupBy("row").agg(F.sum(F.col("k") * F.col("wb")).alias("tb"), F.sum(F.col("k") * F.col("wl")).alias("tl"), F.sum(F.col("k") * F.col("wk")).alias("tk"))
    )
    score = F.col("lm") + F.coalesce("tl", F.lit(0.0))
    return sums.drop("tail").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("tk", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tb", F.lit(0.0))).alias("base_score"), score.alias("score"),
        F.try_divide(-score * F.lit(math.log2(10)), "bytes").alias("bits_per_byte"),
    )


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lm_scores(docs, crc_mod("doc_id", 7) != 2).select(
        "doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )
