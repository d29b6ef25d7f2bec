"""Repair of conversations by the cheapest edits, worked out once for all that end alike.

A conversation's signature has one letter a row, for its role and its fault. Signatures are minimised from the
end: sorted by their reversed form, those that share a suffix follow each other, so every node of the
suffix-shared automaton is made once, and with it, for each state of the grammar of roles, the cost of what
is left and the first edit of its best audit. Nodes whose costs differ by a constant share one table entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import joined, scratch, table, written

#: What counts as space, and what ends a sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: A row's letter is A and 4 times its role's place and its fault's.
ROLES, FAULTS = "suax", ("clean", "blank", "duplicate", "truncated")
LETTERS = {(r, f): chr(65 + 4 * i + j) for i, r in enumerate(ROLES) for j, f in enumerate(FAULTS)}
GONE = "".join(LETTERS[r, f] for r in ROLES for f in ("blank", "duplicate"))
#: States of the grammar (s?(ua)+)?: at the start, after s, u and a. From each, the role that may be put there, and where it leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEPT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}, "x": {}}
MEANING = {letter: what for what, letter in LETTERS.items()}
#: Symbols of a block of a signature, at most.
BLOCK = 65_536


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; nulls as one space) with the faults that the hash of conv_id and turn gives them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    kept = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return kept.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def _key() -> Column:
    """conv_id as text, a null apart from every other."""
    return F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))


def _ordered(rows: DataFrame) -> DataFrame:
    """k, turn, role, h1 and h2 (hashes of the text), text: the columns that order a conversation's rows, and the text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(_key().alias("k"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), text.alias("text"))


ORDER = ("turn", "role", "h1", "h2")


def _runs(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """k, turn, role, h1, h2, run: equal rows of a turn as one, with the letters of all of them; one without letters for each id.

    A row's text is only looked at where it is; the hashes stand for it from there on. Equal rows are counted
    before they move. The join with the first place of texts that stand more than once is an outer one, whose
    large partitions Spark splits.
    """
    inner = F.rtrim(F.col("text"), F.lit(SPACE))
    kind = F.when(inner == "", "blank").when(~F.right(inner, F.lit(1)).isin(*ENDS), "truncated").otherwise("clean")
    each = written(_ordered(rows).select("k", *ORDER, kind.alias("kind")).groupBy("k", *ORDER, "kind").agg(F.count("*").alias("n")))
    same = ["k", "role", "h1", "h2"]
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = each.groupBy(*same).agg(F.min(at).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places")
    initial = F.left("role", F.lit(1))
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")

    def letter(fault: Column) -> Column:
        pairs = [x for (r, f), v in LETTERS.items() for x in (F.lit(r + f), F.lit(v))]
        return F.element_at(F.create_map(*pairs), F.concat(role, fault))

    repeated = lambda fault, n: F.repeat(letter(fault), n.cast("int"))
    copy = F.lit("duplicate")
    is_first = F.col("first").isNull() | (F.col("first") == at)
    run = (
        F.when(F.col("kind") == "blank", repeated(F.col("kind"), F.col("n")))
        .when(is_first, F.concat(letter(F.col("kind")), repeated(copy, F.col("n") - 1)))
        .otherwise(repeated(copy, F.col("n")))
    )
    none = ids.select(_key().alias("k")).distinct().withColumn("run", F.lit(""))
    return each.join(again, same, "left").select("k", *ORDER, run.alias("run")).unionByName(none, allowMissingColumns=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a partition as blocks (k, seq, letters, lowest turn, highest turn, number of different turns)."""
    first = TaskContext.get().partitionId() << 32
    key, letters, size, low, high, turns, made = None, [], 0, None, None, 0, 0

    def block() -> tuple:
        return key, first + made, "".join(letters), low, high, turns

    for b in batches:
        out = []
        for k, turn, run in zip(*(b.column(i).to_pylist() for i in range(3))):
            if k != key or size >= BLOCK:
                if key is not None:
                    out.append(block())
                    made += 1
                key, letters, size, low, high, turns = k, [], 0, None, None, 0
            letters.append(run)
            size += len(run)
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
        if out:
            yield _batch(out)
    if key is not None:
        yield _batch([block()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["k", "seq", "letters", "low", "high", "turns"])


def _signatures(runs: DataFrame) -> DataFrame:
    """k, sig, gaps. Rows are dealt in ranges of their order, so a long conversation is spread over tasks until its rows
    are letters; its signature is as long as its audit."""
    order = [F.col("k"), *(F.col(c).asc_nulls_first() for c in ORDER)]
    dealt = runs.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "turn", "run")
    blocks = dealt.mapInArrow(_blocks, "k string, seq long, letters string, low long, high long, turns long")
    one = blocks.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("seq", "letters", "low", "high", "turns"))).alias("b"))
    twice = "size(filter(sequence(1, greatest(size(b) - 1, 1)), i -> i < size(b) and b[i].low = b[i - 1].high))"
    different = F.expr(f"aggregate(b, 0L, (s, x) -> s + x.turns) - {twice}")
    span = F.expr("cast(array_max(transform(b, x -> x.high)) as decimal(38,0)) - array_min(transform(b, x -> x.low)) + 1")
    return one.select("k", F.array_join(F.transform("b", lambda x: x["letters"]), "").alias("sig"), F.when(span.isNull(), 0).otherwise(F.least(span - different, F.lit(2**63 - 1))).cast("long").alias("gaps"))


class Repairs:
    """Cheapest repairs of signatures, each after those that share a suffix with it.

    ``least`` and ``best`` of a node: costs of what follows in each state, the least of them taken off, and the
    first edit. Edits that cost the same differ in their letter, so the least letter gives the least audit.
    """

    def __init__(self):
        self.known: dict = {}
        self.end = self._node(None, None)
        self.key, self.path = "", [(0, *self.end)]

    def _node(self, letter: str | None, below: tuple | None) -> tuple[int, tuple, str]:
        """What is added to all costs, the costs left, the best edits ('.' ends): of ``letter`` before a node with costs ``below``."""
        if (found := self.known.get((letter, below))) is not None:
            return found
        ways: list[list[tuple[int, str]]] = [[] for _ in NEXT]
        if letter is None:
            ways[START].append((0, "."))
            ways[AFTER_A].append((0, "."))
        else:
            role, fault = MEANING[letter]
            late = TRUNCATED * (fault == "truncated")
            for q in range(4):
                ways[q].append((DELETE + below[q], "D"))
                if letter not in GONE:
                    ways[q].append((REROLE + late + below[NEXT[q]], "R"))
                    if q in KEPT[role]:
                        ways[q].append((KEEP + late + below[KEPT[role][q]], "K"))
        least = [min(w, default=(10**9, ""))[0] for w in ways]
        for _ in NEXT:
            least = [min(c, INSERT + least[NEXT[q]]) for q, c in enumerate(least)]
        for q in range(4):
            ways[q].append((INSERT + least[NEXT[q]], "I"))
        best = "".join(min(w)[1] for w in ways)
        low = min(least)
        self.known[letter, below] = out = (low, tuple(c - low for c in least), best)
        return out

    def of(self, sig: str) -> tuple[int, str]:
        """Cost and audit of a signature."""
        key = sig.translate({ord(c): GONE[0] for c in GONE})[::-1]
        shared = len(commonprefix([key, self.key]))
        del self.path[shared + 1 :]
        for letter in key[shared:]:
            at, _, costs, _ = self.path[-1]
            low, left, best = self._node(letter, costs)
            self.path.append((at + low, low, left, best))
        self.key = key
        audit, state = [], START
        cost = self.path[-1][0] + self.path[-1][2][START]
        for at in range(len(key), -1, -1):
            edits = self.path[at][3]
            while edits[state] == "I":
                audit.append("I")
                state = NEXT[state]
            if edits[state] == ".":
                break
            audit.append(edits[state])
            state = {"D": state, "R": NEXT[state], "K": KEPT[MEANING[key[at - 1]][0]].get(state)}[edits[state]]
        return cost, "".join(audit)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repairs = Repairs()
    for b in batches:
        made = [repairs.of(s) for s in b.column("sig").to_pylist()]
        cost, audit = (list(x) for x in zip(*made)) if made else ([], [])
        yield pa.record_batch([b.column("sig"), b.column("n"), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["sig", "n", "cost", "audit"])


def audits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """k, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``ids``; see ``conversation_audits``."""
    with scratch(rows.sparkSession):
        convs = written(_signatures(written(_runs(rows, ids))))
        sigs = convs.groupBy("sig").agg(F.count("*").alias("n"))
        back = F.reverse(F.translate("sig", GONE, GONE[0] * len(GONE)))
        solved = sigs.repartitionByRange(back).sortWithinPartitions(back).mapInArrow(_solved, "sig string, n long, cost long, audit string")
        of = lambda *faults: "".join(LETTERS[r, f] for r in ROLES for f in faults)
        count = lambda f: (F.length("sig") - F.length(F.translate("sig", of(f), ""))).cast("long").alias(f)
        roles = F.translate("sig", "".join(LETTERS.values()), "".join(r for r, _ in LETTERS))
        wrong = F.greatest(F.length("sig") - 1, F.lit(0)) - F.regexp_count(roles, F.lit("(?=su|ua|au)"))
        solved = written(solved.select("sig", "n", *map(count, FAULTS[1:]), wrong.cast("long").alias("illegal"), "cost", "audit"))
        return written(joined(convs, solved, ["sig"], "n", convs.count()).drop("sig"), result=True)


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCRIPT = "k string, place long, edit string, role string, text string, " + ", ".join(f"{c} long" for c in STATS) + ", audit string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every conversation's audit row, then its edits with the role and text that each leaves, in order.

    Takes the audit row and then the rows of each conversation; only the audit and one batch are in memory.
    """
    key, audit, at, place, state, edits = None, "", 0, 0, START, None
    names = ("k", "place", "edit", "role", "text")
    schema = pa.schema([(n, pa.int64() if n == "place" else pa.string()) for n in names] + [(c, pa.int64()) for c in STATS] + [("audit", pa.string())])
    blank = (None,) * (len(STATS) + 1)

    def put(edit: str, role: str | None = None, text: str | None = None) -> None:
        nonlocal at, place, state
        if edit in "IR":
            role, text, state = ("assistant" if state == AFTER_U else "user"), text or "", NEXT[state]
        elif edit == "K":
            state = KEPT[role[0]][state]
        gone = edit == "D"
        edits.append((key, None if gone else place, edit, None if gone else role, None if gone else text, *blank))
        at, place = at + 1, place + (not gone)

    for b in batches:
        edits = []
        columns = {n: b.column(n).to_pylist() for n in ("k", "edits", "role", "text", *STATS)}
        for k, own, role, text, *stats in zip(*columns.values()):
            if own is not None:  # the next conversation
                while at < len(audit):
                    put("I")
                key, audit, at, place, state = k, own, 0, 0, START
                edits.append((k, None, "", None, None, *stats, own))
                continue
            while audit[at] == "I":
                put("I")
            put(audit[at], role, text)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*edits), schema)], schema=schema) if edits else pa.RecordBatch.from_pylist([], schema)
    edits = []
    while at < len(audit):
        put("I")
    if edits:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*edits), schema)], schema=schema)


def scripts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """SCRIPT: for each conversation a row with its audit (edit '') and then one for each edit, in order and in one partition.

    Texts move once, to be put in the order of their conversation.
    """
    found = audits(rows, ids).withColumnRenamed("audit", "edits")
    both = _ordered(rows).unionByName(found, allowMissingColumns=True)
    order = ["k", F.col("edits").isNull(), *(F.col(c).asc_nulls_first() for c in ORDER)]
    return both.repartition("k").sortWithinPartitions(*order).select("k", "edits", "role", "text", *STATS).mapInArrow(_edited, SCRIPT)


def _id(rows: DataFrame) -> Column:
    return F.when(F.left("k", F.lit(1)) == "+", F.substr("k", F.lit(2))).cast(rows.schema["conv_id"].dataType).alias("conv_id")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0, null if deleted), edit (Keep, Rerole, Delete, Insert by their initials), role, text.

    The edits are the cheapest that make each conversation's role initials read (s?(ua)+)?: keeping a row costs
    0, another role 2, deleting one 3 and inserting an empty one of user or assistant 2; blank rows (nothing but space)
    and repeated ones (role and text seen before) must go, and every truncated row (whose last letter isn't one of .!?)
    that stays costs 1. Among equally cheap audits it is the least in ASCII.

    Rows of a conversation go by turn, nulls first, then role and the text's hash; nulls in role or text are one
    space, rows without conv_id are a conversation of their own. Repeated rows are repeats like others; an
    empty table gives none; other columns aren't read. A conversation's rows stream through one task, one batch in
    memory; its signature and audit, a letter a row, are held whole.
    """
    return scripts(rows, rows.select("conv_id")).where("edit <> ''").select(_id(rows), "place", "edit", "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit rows with the SHA-256 of the repaired conversation, role:text by line: a chain over its rows."""
    names = ["k", *STATS, "audit", "repaired_sha256"]
    held, chain, lines = None, None, 0

    def closed(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *(pa.int64() for _ in STATS), pa.string(), pa.string()]
        columns = zip(*done) if done else [[]] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    for b in batches:
        done = []
        for k, edit, role, text, *stats in zip(*(b.column(n).to_pylist() for n in ("k", "edit", "role", "text", *STATS, "audit"))):
            if edit == "":
                if held:
                    done.append((*held, chain.hexdigest()))
                held, chain, lines = (k, *stats), hashlib.sha256(), 0
            elif edit != "D":
                chain.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        yield closed(done)
    if held:
        yield closed([(*held, chain.hexdigest())])


def conversation_audits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conv_id of ``ids``: gaps in its turns, its faulty rows, role pairs out of order, cost and audit of
    its repair, and the digest of what ``repaired_conversations`` makes of it. Those without rows have zeros."""
    kinds = ", ".join(f"{c} long" for c in STATS)
    out = scripts(rows, ids).mapInArrow(_digests, f"k string, {kinds}, audit string, repaired_sha256 string")
    return out.select(_id(ids), *STATS, "audit", "repaired_sha256")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_audits(damaged(conversations), conversations.select("conv_id"))
