import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import jaccard, lines, passages
from panelforge.llm.common import components
from panelforge.llm.jaccard import boundary, jaccard_components, light_keys, linked, missing, shingles
from tests.llm.conftest import prose


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 10**6)}" if rng.random() < share else w for w in text.split(" "))


def brute(docs, k, num, den):
    rows = [(r.doc_id, shingles((r.text or "").encode(), k)) for r in docs.select("doc_id", "text").collect()]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations([r for r in rows if r[0] is not None], 2):
        both = len(np.intersect1d(a, b))
        if len(a) and len(b) and den * both >= num * (len(a) + len(b) - both):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    return {d: (len(s), find(d)) for d, s in rows if d is not None}


def texts():
    base = [prose(i, n) for i, n in enumerate((8, 12, 22, 30, 45, 90, 300))]
    out = [edited(t, 100 * i + j, s) for i, t in enumerate(base) for j, s in enumerate((0, 0, 0.004, 0.01, 0.02, 0.03, 0.05))]
    return [*out, "one two", "ONE two", "one", "", prose(99, 40)]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [1024, 4])
def test_components_match_brute_force(make, monkeypatch, k, num, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = make(texts())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, k, num).collect()}
    assert got == brute(docs, k, num, 100)


def test_light_sets_meet_exactly_where_they_may_link():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 22, np.uint64))
    for drop, add in ((0, 0), (1, 1), (2, 0), (0, 2)):
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, add, np.uint64)])
        both = len(a) - drop
        meets = bool(set(light_keys(a, 90, 100)) & set(light_keys(b, 90, 100)))
        assert meets or 100 * both < 90 * (len(a) + len(b) - both)
    assert missing(9, 90, 100) == 0 and missing(10, 90, 100) == 1
    assert boundary({12: 100}, 1e9, 90, 100) > 12 and boundary({30: 100}, 0.001, 90, 100) < 30
    assert linked([a, a[1:], a[:3]], 90, 100) == [(0, 1)]


def test_odd_rows(odd, empty):
    got = jaccard_components(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert len(got) == odd.count() and by[0] == [(0, 0)] and by[1] == [(0, 1)] and by[8][0][1] == 2 and len(by[2]) == 2 and by[7] == [(1, 7)]
    assert jaccard_components(empty).count() == 0


def test_union_find_over_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 120)]
    star = [(1000, i) for i in range(1001, 1100)]
    df = spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 121)}, **{i: 1000 for i in range(1000, 1100)}}
    assert components(df.limit(0)).count() == 0


def test_lines_match_brute_force(make):
    rng = random.Random(4)
    pool = [prose(50 + i, 14) for i in range(12)]
    near = [p[:-9] + f"{rng.randint(100, 999)}" for p in pool[:6]]
    docs = make(["\n".join(rng.choice(pool + near + ["", "ok", prose(900 + i, 14)]) for _ in range(6)) for i in range(25)])
    got = {r.doc_id: r.removed for r in lines.repeated_lines(docs).collect()}
    k = lines.SHINGLE
    occurrences = [(r.doc_id, p, x) for r in docs.orderBy("doc_id").collect() for p, x in enumerate(r.text.split("\n")) if x.strip()]
    sets = {x: {b[i : i + k] for b in [x.encode()] for i in range(max(1, len(b) - k + 1))} for _, _, x in occurrences}
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= lines.LEAST * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    seen, want = set(), {}
    for d, p, x in occurrences:
        if find(x) in seen:
            want.setdefault(d, []).append(p)
        seen.add(find(x))
    assert got == want
    kept = {r.doc_id: r.text for r in lines.without_repeated_lines(docs).collect()}
    for r in docs.collect():
        left = [x for i, x in enumerate(r.text.split("\n")) if i not in want.get(r.doc_id, ())]
        assert kept.get(r.doc_id) == ("\n".join(left) if any(x.strip() for x in left) or r.doc_id not in want else None)


def test_a_family_of_drifting_lines_is_one_component(spark):
    rng, k = random.Random(11), lines.SHINGLE
    family = [rng.randbytes(75).hex()]
    while len(family) < 300:  # each with one letter changed, which is up to 9 of 142 shingles
        x = rng.choice(family)
        at = rng.randrange(20, 130)
        family.append(x[:at] + rng.choice("ghijklmnop") + x[at + 1 :])
    family = list(dict.fromkeys(family))
    sets = [{x[i : i + k] for i in range(len(x) - k + 1)} for x in family]
    near = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= lines.LEAST * len(sets[i] | sets[j])}
    df = lines.lines_of(spark.createDataFrame([(i, x) for i, x in enumerate(family)], "doc_id long, text string"))
    ids = {r.id: r.doc_id for r in df.collect()}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in lines.line_links(df).collect()}
    assert found <= near and len(family) > 290
    root = list(range(len(family)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in found:
        root[find(i)] = find(j)
    assert len({find(i) for i in root}) == 1


def test_odd_lines(odd, empty):
    out = lines.without_repeated_lines(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(2) == 2 and 8 not in ids and None in ids and {0, 1, 4, 5, 6, 7, 9} <= set(ids)
    assert lines.without_repeated_lines(empty).count() == 0 and lines.repeated_lines(empty).count() == 0


def test_line_plan_is_native(make):
    df = lines.repeated_lines(make([prose(1, 60), prose(1, 60)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_passages_are_found_and_clean_documents_left_alone(make):
    shared = prose(500, 80)
    fuzzy = edited(shared, 1, 0.04)
    docs = make([prose(1, 300) + "\n" + shared + "\n" + prose(2, 200), prose(3, 150) + "\n" + shared, fuzzy + "\n" + prose(4, 90), prose(5, 400), prose(5, 400), prose(6, 250), prose(7, 30)])
    got = passages.shared_passages(docs).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(1, 0), (2, 0), (4, 3)}
    one = next(r for r in got if r.doc_id == 1)
    n = len(shared.split())
    assert one.equal_words >= n and one.last_word - one.first_word >= n and abs(one.source_first - len(prose(1, 300).split())) <= 3
    assert [r.exact_copy for r in got if r.doc_id == 4] == [True]


def test_chains_match_a_plain_dynamic_programme():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.integers(0, 80, 25), rng.integers(0, 80, 25)
        best = np.zeros(25)
        for i in np.lexsort((y, x)):
            before = [best[j] - passages.GAP * ((x[i] - x[j]) + (y[i] - y[j])) for j in range(25) if x[j] < x[i] and y[j] < y[i] and max(x[i] - x[j], y[i] - y[j]) <= passages.MOST_GAP]
            best[i] = passages.K + max([0, *before])
        found = passages.chains(x, y)
        top = found[0]
        score = sum(passages.K - (passages.GAP * ((x[b] - x[a]) + (y[b] - y[a])) if a >= 0 else 0) for a, b in zip([-1, *top], top))
        assert np.isclose(score, best.max()) and all(x[a] < x[b] and y[a] < y[b] for a, b in zip(top, top[1:]))


def test_every_chain_of_two_passages_far_apart():
    for first, own, second in [(100, 65, 100), (100, 100, 100), (500, 300, 200), (60, 100, 60), (100, 2000, 100)]:
        x = np.array([*range(0, first, 5), *range(first + own, first + own + second, 5)])
        for y in (x, np.where(x < first, x, x - own + 70)):  # own words on both sides, and fewer on one
            assert sorted(passages.chains(x, y)) == [[*range(first // 5)], [*range(first // 5, len(x))]]
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 600, 150), rng.integers(0, 600, 150)
        best = np.zeros(150)
        for i in np.lexsort((y, x)):
            before = [best[j] - passages.GAP * ((x[i] - x[j]) + (y[i] - y[j])) for j in range(150) if 0 < x[i] - x[j] <= passages.MOST_GAP and 0 < y[i] - y[j] <= passages.MOST_GAP]
            best[i] = passages.K + max([0, *before])
        found = passages.chains(x, y)
        assert sum(np.isclose(best.max(), sum(passages.K - (passages.GAP * ((x[b] - x[a]) + (y[b] - y[a])) if a >= 0 else 0) for a, b in zip([-1, *c], c))) for c in found[:1]) == 1


def test_a_short_own_paragraph_between_two_passages(make):
    def words(seed, n):
        return prose(seed, n).replace("\n", " ").split()

    cases = [(60, 50, 60), (55, 40, 55), (80, 60, 300), (60, 5, 60)]
    texts = []
    for c, (n, own, m) in enumerate(cases):
        head, tail = words(600 + c, n), words(700 + c, m)
        texts += [" ".join([*words(800 + i * 10 + c, 90), *head, *words(900 + i * 10 + c, own), *tail, *words(950 + i * 10 + c, 90)]) for i in range(2)]
    got = {}
    for r in passages.shared_passages(make(texts)).collect():
        assert r.source_id == r.doc_id - 1 and r.equal_words >= 0.8 * (r.last_word - r.first_word)
        got.setdefault(r.source_id // 2, []).append((r.source_first, r.source_last))
    want = {c: [(90, 90 + n), (90 + n + own, 90 + n + own + m)] if own > 5 else [(90, 90 + n + own + m)] for c, (n, own, m) in enumerate(cases)}
    assert got.keys() == want.keys()
    for c, found in got.items():  # a word or two of the neighbourhood may be equal by chance
        assert len(found) == len(want[c]) and np.abs(np.subtract(sorted(found), want[c])).max() <= 3


def test_odd_passages(odd, empty):
    got = {(r.doc_id, r.source_id, r.exact_copy) for r in passages.shared_passages(odd).collect()}
    assert got == {(8, 2, True)} and passages.shared_passages(empty).count() == 0


def test_a_whole_passage_is_found_although_earlier_documents_hold_parts_of_it(make):
    def own(seed, n):
        rng = random.Random(seed)
        return [f"{rng.choice('bdfgklmnprst')}{rng.randrange(10**6)}" for _ in range(n)]

    texts, pairs = [], []
    for case in range(12):
        shared, n, own_ = own(5000 + case, 64), len(texts), iter(range(10 * case, 10 * case + 10))
        texts += [own(next(own_), 60) + shared[:32] + own(next(own_), 60), own(next(own_), 60) + shared[32:] + own(next(own_), 60)]
        texts += [own(next(own_), 40) + shared + own(next(own_), 50), own(next(own_), 50) + shared + own(next(own_), 40)]
        pairs.append((n + 3, n + 2))
    got = {(r.doc_id, r.source_id): r for r in passages.shared_passages(make([" ".join(t) for t in texts])).collect()}
    assert got.keys() == set(pairs)
    assert all(r.last_word - r.first_word >= 64 and r.equal_words >= 64 for r in got.values())


@pytest.mark.parametrize(("share", "least"), [(0.0, 1.0), (0.05, 0.95), (0.1, 0.9)])
def test_recall_of_fuzzy_passages_against_what_was_planted(make, share, least):
    texts = []
    for i in range(60):
        shared = prose(3000 + i, 70).replace("\n", " ")
        texts += [prose(4000 + i, 90) + " " + shared, edited(shared, i, share) + " " + prose(6000 + i, 80)]
    docs = make([t.replace("\n", " ") for t in texts])
    got = {(r.doc_id, r.source_id) for r in passages.shared_passages(docs).collect()}
    want = {(2 * i + 1, 2 * i) for i in range(60)}
    assert len(got & want) >= least * len(want) and not got - want


def test_of_rows_that_repeat_an_id_one_counts(spark):
    shared = prose(77, 80)
    rows = [(1, prose(78, 100)), (1, prose(79, 60) + " " + shared), (2, shared + " " + prose(80, 60)), (None, shared)]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id) for r in got} <= {(2, 1)} and len(got) <= 1


def test_recall_of_line_signatures(spark):
    rng, near = random.Random(5), {}
    for n in (5, 10, 40, 100, 400):
        while len(near.setdefault(n, [])) < 200:  # a changed end: of n shingles each, 8 in 9 of them are shared by both
            x = "".join(rng.choice("abcdefghijklmnop") for _ in range(n + lines.SHINGLE - 1))
            cut = max(1, round(n / 10))
            y = x[:-cut] + "".join(rng.choice("qrstuvwxyz") for _ in range(cut))
            a, b = ({z[i : i + lines.SHINGLE] for i in range(n)} for z in (x, y))
            if len(a & b) >= lines.LEAST * len(a | b):
                near[n].append((x, y))
            elif n == 5:  # four of six are the nearest that different sets of five come to
                near.pop(n)
                break
    texts = [z for pairs in near.values() for pair in pairs for z in pair]
    df = lines.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ids = {r.id: r.doc_id for r in df.collect()}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in lines.line_links(df).collect()}
    at = 0
    for n, pairs in near.items():
        got = sum((at + 2 * i, at + 2 * i + 1) in found for i in range(len(pairs)))
        assert got >= 0.97 * len(pairs), (n, got)
        at += 2 * len(pairs)


def changed_at(rng, text, where, least, most):
    """``text`` with letters changed at its head, middle or tail until its similarity is from ``least`` to ``most``."""
    k = lines.SHINGLE
    own = {text[i : i + k] for i in range(len(text) - k + 1)}
    for n in range(1, len(text)):
        at = {"head": 0, "middle": (len(text) - n) // 2, "tail": len(text) - n}[where]
        other = text[:at] + "".join(rng.choice("0123456789") for _ in range(n)) + text[at + n :]
        sets = {other[i : i + k] for i in range(len(other) - k + 1)}
        alike = len(own & sets) / len(own | sets)
        if alike < least:
            return None
        if alike <= most:
            return other


@pytest.mark.parametrize("repeats", [False, True])
def test_recall_of_edits_anywhere_and_of_lines_that_repeat_themselves(spark, repeats):
    rng, near = random.Random(8), {}
    letters = "abcdefghijklmnopqrstuvwxyz "
    for where in ("head", "middle", "tail"):
        for least, most in ((0.8, 0.87), (0.9, 0.94), (0.95, 0.99)):
            held = near.setdefault((where, least), [])
            while len(held) < 30:
                n = rng.choice((96, 130, 200, 500, 1500, 5000))
                unit = "".join(rng.choice(letters) for _ in range(rng.choice((40, 90, 200)) if repeats else n))
                x = (unit * (n // len(unit) + 1))[: max(n, len(unit))]
                if (y := changed_at(rng, x, where, least, most)) is not None:
                    held.append((x, y))
    near["Home", 0.9] = [(u * 12, "Home " + u * 12) for u in ("".join(rng.choice(letters) for _ in range(70)) + " " for _ in range(40))] if repeats else []
    texts = [z for pairs in near.values() for pair in pairs for z in pair]
    df = lines.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ids = {r.id: r.doc_id for r in df.collect()}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in lines.line_links(df).collect()}
    at, got, all_ = 0, 0, 0
    for kind, pairs in near.items():
        own = sum((at + 2 * i, at + 2 * i + 1) in found for i in range(len(pairs)))
        assert own >= 0.95 * len(pairs), (kind, own)
        at, got, all_ = at + 2 * len(pairs), got + own, all_ + len(pairs)
    assert got >= 0.99 * all_, (got, all_)


def rare(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('bdfgklmnprst')}{rng.randrange(10**6)}" for _ in range(n)]


def over(r, first, last):
    """Words of [first, last) that a row covers in its document."""
    return max(0, min(r.last_word, last) - max(r.first_word, first))


@pytest.mark.parametrize("share", [0.0, 0.06])
def test_passages_whose_parts_overlap_in_earlier_documents(make, share):
    """Three earlier documents hold 46 of 70 words each, two later ones hold all: these two must meet."""
    texts, pairs = [], []
    for case in range(20):
        shared, n = rare(9000 + case, 70), len(texts)
        for i, (p, q) in enumerate([(0, 46), (12, 58), (24, 70)]):
            texts.append(rare(100_000 + 10 * case + i, 50) + shared[p:q] + rare(200_000 + 10 * case + i, 50))
        for i in (3, 4):
            said = edited(" ".join(shared), 50 * case + i, share if i == 4 else 0).split()
            texts.append(rare(100_000 + 10 * case + i, 40 + i) + said + rare(200_000 + 10 * case + i, 40))
        pairs.append((n + 4, n + 3))
    got = passages.shared_passages(make([" ".join(t) for t in texts])).collect()
    found = {(r.doc_id, r.source_id) for r in got if over(r, 44, 114) >= 50}
    assert {(r.doc_id, r.source_id) for r in got} <= set(pairs) and len(found & set(pairs)) >= (20 if not share else 18)


def test_recall_over_random_overlapping_parts_against_all_pairs(make):
    """Drifting parts of one long text: each document's longest common part of 60 words or more with any earlier one is covered."""
    rng, texts, parts = random.Random(12), [], []
    for case in range(8):
        long = rare(7000 + case, 260)
        for i in range(10):
            p, n = rng.randrange(0, 160), rng.randint(35, 100)
            parts.append((case, p, p + n, 30 + i))
            texts.append(rare(300_000 + 10 * case + i, 30 + i) + long[p : p + n] + rare(400_000 + 10 * case + i, 30))
    rows = passages.shared_passages(make([" ".join(t) for t in texts])).collect()
    want = hit = 0
    for j, (case, p, q, at) in enumerate(parts):
        best = max([(min(q, q0) - max(p, p0), max(p, p0)) for c, p0, q0, _ in parts[:j] if c == case], default=(0, 0))
        if best[0] >= 60:
            want += 1
            first = best[1] - p + at
            hit += any(r.doc_id == j and over(r, first, first + best[0]) >= 50 for r in rows)
    assert want >= 10 and hit >= 0.9 * want
    for r in rows:  # nothing is reported that isn't shared
        a, b = texts[r.source_id][r.source_first : r.source_last], texts[r.doc_id][r.first_word : r.last_word]
        assert min(len(a), len(b)) >= 50 and len(set(a) & set(b)) >= 0.8 * max(len(a), len(b))


def test_a_passage_that_stands_twice_in_a_document_is_two_rows(make):
    shared = rare(1, 200)
    first = rare(2, 80) + shared + rare(3, 40)
    twice = rare(4, 50) + shared + rare(5, 80) + shared + rare(6, 30)
    got = passages.shared_passages(make([" ".join(t) for t in (first, twice, rare(7, 300))])).collect()
    assert sorted((r.doc_id, r.first_word, r.last_word) for r in got) == [(1, 50, 250), (1, 330, 530)]


def test_nearest_matches_and_stretches():
    a, b = np.array([1, 2, 3, 4, 5, 6, 9, 1, 2, 3, 4, 5], np.int32), np.array([7, 1, 2, 3, 4, 5, 8], np.int32)
    for off, want in ((-1, 0), (6, 7), (100, 7), (-100, 0)):
        x, y = passages.nearest(a, b, off)
        assert (x.tolist(), y.tolist()) == ([want], [1])
    x, y = passages.nearest(a, np.array([8] * 9, np.int32), 0)
    assert not len(x) and not len(y)
    rows = np.array([(10, 110, 50, 150), (30, 130, 80, 180), (900, 1000, 940, 1040), (10, 400, 50, 440)])
    assert set(passages.stretches(*rows.T)) == {(10, 80, 110, 180), (10, 50, 400, 440), (900, 940, 1000, 1040)}


def test_rows_of_a_document_of_many_partners_are_dealt_in_parts(make, monkeypatch):
    monkeypatch.setattr(passages, "PART", 3)
    shared = rare(11, 80)
    docs = make([" ".join(rare(1000 + i, 30) + shared + rare(2000 + i, 20)) for i in range(12)])
    assert {(r.doc_id, r.source_id, r.first_word, r.last_word) for r in passages.shared_passages(docs).collect()} == {(i, 0, 30, 110) for i in range(1, 12)}


def test_elections_go_on_where_one_finds_nothing(make):
    """Many earlier documents hold two parts of a passage each, so that whichever is elected first has no passage with the last two."""
    said, texts = rare(9, 66), []
    for i in range(0, 36, 2):
        for j in range(i + 30, 66, 2):
            kept = {*range(i - 7, i + 12), *range(j - 7, j + 12)}
            texts.append([w if k in kept else own for k, (w, own) in enumerate(zip(said, rare(1000 + 100 * i + j, 66)))])
    decoys, other = len(texts), rare(2, 66)
    texts += [rare(3, 40) + said + rare(4, 30), rare(5, 50) + [o if k % 12 == 11 else w for k, (w, o) in enumerate(zip(said, other))] + rare(6, 40)]
    got = passages.shared_passages(make([" ".join(t) for t in texts])).collect()
    assert any(r.doc_id == decoys + 1 and r.source_id == decoys and over(r, 50, 116) >= 50 for r in got)


def test_bitmaps_rule_out_pairs_that_are_not_near_and_no_others(spark):
    rng = random.Random(21)
    k, texts = lines.SHINGLE, []
    for n in (12, 60, 300, 2000):
        for share in (0.0, 0.005, 0.01, 0.02, 0.04, 0.08):
            x = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
            texts += [x, "".join(rng.choice("0123456789") if rng.random() < share else c for c in x), x + x[: n // 6]]
    df = lines.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    maps = lines.bitmaps(df.select("doc_id", "id", "line").dropDuplicates(["id"]), k)
    of = df.dropDuplicates(["id"]).join(maps, "id").select("doc_id", F.struct("most", "bits").alias("of"))
    pair = of.select(F.col("doc_id").alias("a"), F.col("of").alias("x")).join(of.select(F.col("doc_id").alias("b"), F.col("of").alias("y")), F.col("a") < F.col("b"))
    may = {(r.a, r.b) for r in pair.where(lines.may_link("x", "y", lines.LEAST)).select("a", "b").collect()}
    sets = {i: {t[j : j + k] for j in range(max(1, len(t) - k + 1))} for i, t in enumerate(texts)}
    ids = {r.doc_id for r in of.select("doc_id").collect()}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(ids), 2)}
    assert {p for p, j in alike.items() if j >= lines.LEAST} <= may
    assert not {p for p, j in alike.items() if j < 0.5 and len(texts[p[0]]) < 500 and len(texts[p[1]]) < 500} & may


def test_a_pair_that_meets_in_several_bands_is_compared_once(spark, monkeypatch):
    """Lines that are alike but not near enough, all of one bucket or more: pairs grow by their number, not by that of the bands."""
    rng, found = random.Random(22), []
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(70))
    own = [base[: 4 * i + 8] + str(10 + i) + base[4 * i + 10 :] for i in range(12)]
    df = lines.lines_of(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"))
    sig = lines.signatures(df.select("id", "line"), lines.SHINGLE)
    rooted = sig.select("id", "level", F.posexplode(lines.band_keys()).alias("band", "key"), F.col("id").alias("root"), F.lit(1).alias("weight"))
    monkeypatch.setattr(type(df), "distinct", lambda self: found.append(self) or self)
    pairs = lines._all_pairs(rooted, sig).collect()
    assert found and len(pairs) == len(set(pairs)) > 0


def test_shingles_said_by_chance_connect_no_candidates(spark, make, monkeypatch):
    rng = random.Random(5)
    said = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(3)) for _ in range(60)]
    texts = [" ".join(rng.sample(said, 8)) for _ in range(400)]  # every shingle is in many texts, next to no two are alike
    texts += [t + " x" for t in texts[:5]]
    sizes = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda read, first, groups, *a: sizes.extend(groups.groupBy("root").count().toPandas()["count"]) or verified(read, first, groups, *a))
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    docs = make(texts)
    for k, num, den in ((3, 90, 100), (3, 60, 100)):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs.select("doc_id", "text"), k, num, den).collect()}
        sets = [frozenset(zip(*(t.split()[i:] for i in range(k)))) for t in texts]
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    a, z = sorted((root[i], root[j]))
                    root = [a if r == z else r for r in root]
        assert [got[i] for i in range(len(sets))] == root
        if num == 90:
            assert 0 < max(sizes) < 40  # all that met at a key was one group of hundreds


def test_a_word_is_hashed_once_for_a_run_of_texts(monkeypatch):
    import pyarrow as pa
    import xxhash

    from panelforge.llm import mixing

    texts = [b"River STONE\triver", b"", b"stone  \x00\xc3\x84b river\n", b"\n"]
    seen, one = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(mixing.xxhash, "xxh3_64_intdigest", lambda w: seen.append(w) or one(w))
    ((part, t),) = mixing.tokens(pa.array(texts, pa.binary()))
    assert t.hashes().tolist() == [one(w) for x in texts for w in x.lower().split()] and t.count.tolist() == [3, 0, 3, 0]
    assert sorted(seen) == sorted({w for x in texts for w in x.lower().split()})
    monkeypatch.setattr(mixing, "TEXTS", 20)
    assert [n for _, t in mixing.tokens(pa.array(texts, pa.binary())) for n in t.count.tolist()] == [3, 0, 3, 0]
