"""Language identification by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import crc_mod, table

#: Characters learnt per language; documents looked at for them, and their length; length of the lanes
#: that texts are cut into (of no influence on results).
LEARN_CHARS, LEARN_DOCS, LEARN_LENGTH, LANE = 16_000, 64, (200, 4_000), 512
#: Codes of what is no letter, and of letters no language has shown.
GAP, UNKNOWN = 0, 1
#: Characters that are coded at a time.
SLAB = 1_000_000


@cache
def is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """All substrings of one text: ``step[state, code]`` is the next state, 0 if there is none; the root is 1."""

    def __init__(self, codes: list[int], n_codes: int):
        link, length, step = [0, 0], [-1, 0], [[0] * n_codes, [0] * n_codes]
        last = 1
        for c in codes:
            new = len(step)
            length.append(length[last] + 1)
            step.append([0] * n_codes)
            link.append(1)
            p = last
            while p and not step[p][c]:
                step[p][c] = new
                p = link[p]
            if p:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(step)
                    length.append(length[p] + 1)
                    step.append(step[q][:])
                    link.append(link[q])
                    while p and step[p][c] == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.step = np.array(step, np.int32).ravel()
        self.n = len(codes)


class Model:
    """One automaton per language over one common coding of letters."""

    def __init__(self, texts: dict[str, str]):
        seen = np.unique(np.concatenate([points(t.lower()) for t in texts.values()])) if texts else np.empty(0, np.uint32)
        seen = seen[is_letter()[seen]]
        self.letters, self.n_codes = seen, len(seen) + 2
        self.langs = sorted(texts)
        self.automata = [Automaton(self.coded(texts[k])[:LEARN_CHARS].tolist(), self.n_codes) for k in self.langs]
        self._table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def coded(self, text: str) -> np.ndarray:
        """Codes of the lower-cased text; runs of what is no letter become one gap."""
        if getattr(self, "_table", None) is None:
            self._table = np.where(is_letter(), UNKNOWN, GAP).astype(np.int32)
            self._table[self.letters] = np.arange(2, self.n_codes)
        c = self._table[points(text.lower())]
        return c[np.concatenate([[True], (c[1:] != GAP) | (c[:-1] != GAP)])] if len(c) else c

    def starts(self, a: Automaton, lanes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases start in each lane (column) that begins with a phrase, and the state after it.

        ``many``: how many of the lanes, the longest first, reach each place.
        """
        state, new_phrase = np.ones(lanes.shape[1], np.int32), np.zeros(lanes.shape, bool)
        for i, m in enumerate(many):
            c, s = lanes[i, :m], state[:m]
            new = a.step[s * self.n_codes + c]
            stuck = new == 0  # a phrase ends before this code, which begins the next
            new_phrase[i, :m] = stuck | (s == 1)
            at = np.flatnonzero(stuck)
            if len(at):
                again = a.step[self.n_codes + c[at]]
                new[at] = np.where(again == 0, 1, again)  # or is one of its own
            state[:m] = new
        return new_phrase, state

    def run_on(self, a: Automaton, lanes: np.ndarray, sizes: np.ndarray, new_phrase: np.ndarray, at: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of phrases in ``state`` that go on into the lanes ``at``: how many more start there than if a phrase began with the
        lane, up to where both ways to parse it meet; and which have not met before the lane's end."""
        more, live, state = np.zeros(len(at), np.int64), np.flatnonzero(state != 1), state.copy()
        lost = np.zeros(len(at), bool)
        for i in range(len(lanes) + 1):
            ended = sizes[at[live]] <= i
            lost[live[ended]] = True
            live = live[~ended]
            if not len(live):
                break
            lane = at[live]
            c, s = lanes[i, lane], state[live]
            new = a.step[s * self.n_codes + c]
            stuck = (new == 0) | (s == 1)
            again = a.step[self.n_codes + c[stuck]]
            new[stuck] = np.where(again == 0, 1, again)
            state[live] = new
            fresh = new_phrase[i, lane]
            met = stuck & fresh  # from here on the parses are one
            more[live[~met]] += stuck[~met].astype(np.int64) - fresh[~met]
            live = live[~met]
        return more, lost

    def phrases(self, lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many longest matches each language needs to parse each lane (column; the longest lanes first) by itself."""
        many = np.searchsorted(-sizes, -np.arange(1, len(lanes) + 1), "right")
        return np.array([self.starts(a, lanes, many)[0].sum(0) for a in self.automata]).reshape(len(self.langs), lanes.shape[1])

    def parsed(self, codes: list[np.ndarray], lane: int | None = None) -> np.ndarray:
        """How many longest matches each language needs to parse each text, from its start to its end.

        Texts are cut into lanes that are parsed side by side. A phrase that reaches over the end of a lane is
        followed into the next until a phrase ends where one ended there, too; from there on the next
        lane's phrases are the text's. If that doesn't happen before its end, and it isn't the text's last, the text is
        parsed again in lanes four times as long, beside all others of which that is so; at last they are whole texts.
        """
        lane = lane or LANE
        laid = self.laid(codes, lane)
        return np.array([self.parsed_by(a, codes, lane, laid) for a in self.automata], np.int64).reshape(len(self.langs), len(codes))

    @staticmethod
    def laid(codes: list[np.ndarray], lane: int) -> tuple[np.ndarray, ...]:
        """Lanes (columns, the longest first), their sizes, texts and how many reach each place; of each but a text's last, its column and
        the next one's, and whether that is the last."""
        n = np.array([len(c) for c in codes], np.int64)
        pieces = -(-n // lane)
        owner = np.repeat(np.arange(len(codes)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(lane, n[owner] - place * lane)
        order = np.argsort(-size, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        high = int(size.max(initial=0))
        flat, start = np.concatenate([*codes, np.zeros(high, np.int32)]), (np.cumsum(n) - n)[owner] + place * lane
        lanes = flat[start[order][None, :] + np.arange(high)[:, None]]
        many = np.searchsorted(-size[order], -np.arange(1, high + 1), "right")
        before = np.flatnonzero(place + 1 < pieces[owner])
        return lanes, size[order], owner[order], many, where[before], where[before + 1], place[before] + 2 == pieces[owner[before]]

    def parsed_by(self, a: Automaton, codes: list[np.ndarray], lane: int, laid: tuple[np.ndarray, ...]) -> np.ndarray:
        lanes, size, owner, many, before, after, ends = laid
        out = np.zeros(len(codes), np.int64)
        if not len(owner):
            return out
        new_phrase, state = self.starts(a, lanes, many)
        np.add.at(out, owner, new_phrase.sum(0))
        if len(before):
            more, lost = self.run_on(a, lanes, size, new_phrase, after, state[before])
            np.add.at(out, owner[before], more)
            if len(again := np.unique(owner[before[lost & ~ends]])):
                some = [codes[i] for i in again]
                out[again] = self.parsed_by(a, some, 4 * lane, self.laid(some, 4 * lane))
        return out

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language that needs fewest phrases per character, and its margin over the next as a share.

        Of languages that need equally few the first by name is taken.
        """
        coded = [self.coded(t) for t in texts]
        n = np.array([len(c) for c in coded])
        letters = np.array([bool((c != GAP).any()) for c in coded], bool)
        total = self.parsed(coded)
        cost = total * np.array([[np.log2(a.n + 2)] for a in self.automata]) / np.maximum(n, 1) if self.langs else total
        lang, score = [], []
        for i in range(len(texts)):
            if not letters[i] or not self.langs:
                lang.append("und")
                score.append(0.0)
                continue
            best = int(np.argmin(cost[:, i]))  # ties: the first in order of names
            rest = np.delete(cost[:, i], best)
            lang.append(self.langs[best])
            score.append(1.0 if not len(rest) else float(rest.min() / (rest.min() + cost[best, i])) if rest.min() > 0 else 0.5)
        return lang, score


def learn(docs: DataFrame) -> Model:
    """A model of the labelled documents (doc_id, text, lang) in a bounded sample.

    Of each language the LEARN_DOCS documents with the smallest hashed ids are taken, those of LEARN_LENGTH
    characters first, and their first LEARN_CHARS codes learnt. Null texts and languages are not learnt from.
    """
    ok = docs.where("text is not null and lang is not null")
    odd = (~F.length("text").between(*LEARN_LENGTH)).cast("int")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("odd", "h", "doc_id", "short"))
    rows = (
        ok.select("lang", "doc_id", F.substring("text", 1, LEARN_CHARS).alias("short"), odd.alias("odd"), F.xxhash64("doc_id").alias("h"))
        .withColumn("r", place).where(F.col("r") <= LEARN_DOCS).orderBy("lang", "r").collect()
    )
    texts: dict[str, str] = {}
    for r in rows:
        if len(texts.get(r.lang, "")) < 2 * LEARN_CHARS:
            texts[r.lang] = texts.get(r.lang, "") + "\n" + r.short
    return Model(texts)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text), from its whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learnt. Repeated rows
    each keep theirs; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SLAB):
                    size += len(texts[end])
                    end += 1
                lang, score = sent.value.judge(texts[at:end])
                yield pa.record_batch([pa.array(ids[at:end], pa.int64()), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learn(docs.where(crc_mod("doc_id", 5) != 0))
    return identified(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
