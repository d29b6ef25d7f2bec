import hashlib
import heapq
import random
import zlib

import pytest

from panelforge.llm.conversations import Repairs, conversation_audits, damaged, op13_repair, repaired_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def broken(rows):
    """The damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        inner = text.strip(SPACE)
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "" if inner[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(roles, faults):
    """Every way to edit, by cost and then audit: (cost, audit, [(row or None, role)])."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if i == len(roles) and last in ("", "a"):
            return cost, audit, made
        if (i, last) in done:
            continue
        done.add((i, last))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for r in follows.replace("s", ""):
            heapq.heappush(heap, (cost + 2, audit + "I", i, r, (*made, (None, r))))
        if i < len(roles):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, made))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if roles[i][:1] and roles[i][0] in follows:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, roles[i][0], (*made, (i, None))))
                for r in follows.replace("s", ""):
                    heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, r, (*made, (i, r))))


NAMES = {"u": "user", "a": "assistant"}


def brute(rows, ids):
    """conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines)."""
    out = {}
    for conv in set(ids):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        faults, roles = faults_of(own), [r[2] for r in own]
        cost, audit, made = cheapest(roles, faults)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        wrong = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        lines = [f"{NAMES[r] if r else own[i][2]}:{'' if i is None else own[i][3]}" for i, r in made]
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit, lines)
    return out


def compared(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.conv_id]
        assert tuple(r)[1:-1] == w[:-1], r.conv_id
        assert r.repaired_sha256 == hashlib.sha256("\n".join(w[-1]).encode()).hexdigest(), r.conv_id


def test_whole_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    compared(op13_repair(spark, "/root/testdata/sf0.01").collect(), brute(broken(rows), [r[0] for r in rows]))


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.choice((0, 1, 3, 8, 40))):
            if rng.random() < 0.1:
                continue
            text = rng.choice(("", " \n", "yes.", "no!", "what", "one two. ", "(so)", f"word {rng.randint(0, 9)}?"))
            rows.append((conv, turn * 3, rng.choice(("system", "user", "assistant", "assistant", "user", "unknown", "tool", "")), text))
    rng.shuffle(rows)
    compared(conversation_audits(spark.createDataFrame(rows, SCHEMA), spark.range(60).withColumnRenamed("id", "conv_id")).collect(), brute(rows, range(60)))


def test_nulls_repeats_long_texts_and_other_columns(spark):
    rows = [
        (None, None, "user", "a."), (None, 1, "assistant", "b."), (1, None, None, None), (1, 2, "user", None), (1, 2, "user", None), (2, None, "user", "hi."),
        (2, 0, "assistant", "x" * 300_000), (3, -(2**63), "user", "q."), (3, 2**63 - 1, "assistant", "r."), (4, 5, "Ünï", "日本."), (5, 1, "user", "t. "),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k", "2 as edit", "3 as sig", "4 as cost", "5 as n", "6 as h1")
    plain = spark.createDataFrame([r for r in rows if r[0] != 3], SCHEMA).selectExpr("*", "'s' as k", "2 as edits", "5 as n")
    compared(op13 := conversation_audits(damaged(plain), plain.select("conv_id")).collect(), brute(broken([r for r in rows if r[0] != 3]), [r[0] for r in rows if r[0] != 3]))
    assert len(op13) == 5
    edits = repaired_conversations(df.where("conv_id = 3")).collect()
    assert [(r.place, r.edit, r.role, r.text) for r in edits] == [(0, "K", "user", "q."), (1, "K", "assistant", "r.")]
    empty = df.limit(0)
    assert conversation_audits(empty, empty).count() == 0 and repaired_conversations(empty).count() == 0


def test_conversations_without_rows(spark):
    ids = spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")
    got = conversation_audits(spark.createDataFrame([], SCHEMA), ids).collect()
    assert {tuple(r) for r in got} == {(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in (7, None)}


def test_a_long_conversation_is_cut_into_blocks_and_put_together(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(1, t // 2, rng.choice(("user", "assistant", "assistant", "system")), f"t{rng.randint(0, 1500)}{rng.choice('.!?x')}") for t in range(3000)]
    rows = list({(r[1], r[2]): r for r in rows}.values())  # one row of a turn and role, so that their order is known
    rows.sort(key=lambda r: (r[1], r[2]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compared(conversation_audits(spark.createDataFrame(rows, SCHEMA), spark.range(1, 2).withColumnRenamed("id", "conv_id")).collect(), brute(rows, [1]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nodes_are_shared():
    """Signatures with a common end make its nodes once, and nodes of equal costs are one entry."""
    repairs = Repairs()
    for s in sorted(("EIEIEI", "AEIEIEI", "MEIEIEI", "FIEIEI", "EI" * 500), key=lambda s: s[::-1]):
        cost, audit = repairs.of(s)
        assert audit.count("K") + audit.count("D") + audit.count("R") == len(s)
    assert len(repairs.known) < 20


def test_repaired_rows_follow_the_grammar(spark):
    rows = [(1, 0, "assistant", "b."), (1, 1, "system", "c."), (1, 2, "user", "d"), (1, 2, "user", "d"), (2, 0, "system", "s."), (2, 1, "user", "u.")]
    got = repaired_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    for conv in (1, 2):
        kept = sorted((r.place, r.role) for r in got if r.conv_id == conv and r.place is not None)
        roles = "".join(role[0] for _, role in kept)
        assert [p for p, _ in kept] == list(range(len(kept))) and roles.lstrip("s") == "ua" * (len(roles.lstrip("s")) // 2)
