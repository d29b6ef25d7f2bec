import math
import pickle
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import mixing, neighbours, reputation, tiling
from tests.llm.conftest import prose


def test_urls_follow_rules_and_parts(spark):
    cases = [
        ("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://a.example.com/en/2", "a.example.com", "/en/2", "example.com/en/", "block"),
        ("http://x.com", "x.com", "", None, None), ("http://x.com/", "x.com", "/", "com/", "allow"), ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        ("http://ÄB.net?u=/fr/", "Äb.net", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h", 5) for i, c in enumerate(cases)], "page_id long, url string, html string, bound int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for got in (reputation.judged(pages, labels), reputation.judged(pages.union(pages).distinct(), labels.limit(0))):
        rows = sorted(got.collect(), key=lambda r: r.page_id)
        assert [(r.host, r.path, r.rule) for r in rows] == [c[1:4] for c in cases]
        assert all(r.verdict == c[4] for r, c in zip(rows, cases) if c[4]) and all(r.verdict in ("allow", "block") for r in rows)
    assert reputation.judged(pages.limit(0), labels).count() == 0


def test_reputation_shrinks_and_matches_sql(spark):
    rows = [(h, i, int(i % 10 < good)) for h, n, good in (("bad.site.net", 60, 1), ("fine.site.net", 60, 9), ("few.site.net", 2, 0), ("a.other.org", 30, 9)) for i in range(n)]
    pages = spark.createDataFrame([(i, f"http://{h}/p/{i}") for i, (h, _, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, g, 0) for i, (_, _, g) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = reputation.judged(pages, labels).toPandas().sort_values("page_id").reset_index(drop=True)
    verdict = got.groupby("host").verdict.first()
    assert verdict["bad.site.net"] == "block" and verdict["fine.site.net"] == verdict["few.site.net"] == "allow"
    assert got[got.host == "few.site.net"].bound.iloc[0] > got[got.host == "bad.site.net"].bound.iloc[0]
    c = duckdb.connect()
    c.register("pages", pages.toPandas())
    c.register("labels", labels.toPandas())
    want = c.sql(reputation.SQL).df().sort_values("page_id").reset_index(drop=True)
    assert (got.fillna("~")[want.columns] == want.fillna("~")).all().all()


def test_base_score_and_a_proper_model(spark, make, odd, empty):
    docs = make([prose(i, 30 + i) if i % 9 else "" for i in range(80)])
    train = F.col("doc_id") % 5 != 0
    got = {r.doc_id: r for r in mixing.lm_scores(docs, train).collect()}
    tokens = {r.doc_id: [*(r.text or "").lower().split(), None] for r in docs.collect()}
    c = Counter(w for d, t in tokens.items() if d % 5 for w in t)
    n, v = sum(c.values()), len(c)
    for d, t in tokens.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    text = sum(r.score for d, r in got.items() if d % 5 == 0) / sum(r.n_tokens for d, r in got.items() if d % 5 == 0)
    assert text > -4 and got[1].bits_per_byte < 4
    out = mixing.lm_scores(odd, F.col("doc_id") != 4)
    assert out.count() == odd.count() and out.where("score is null or base_score is null").count() == 0
    assert mixing.lm_scores(empty, F.lit(True)).count() == 0
    assert mixing.lm_scores(odd, F.lit(False)).where("base_score <> 0 or n_known <> 0").count() == 0


def test_bit_probabilities_sum_to_one():
    words = [w.encode() for w in prose(1, 300).split()]
    n = np.zeros((int(mixing._offsets[-1]), 2))
    text, word, contexts = mixing.spelt(words)
    for node, bit in mixing.bits(text):
        for s in mixing.slots(contexts, node):
            np.add.at(n, (s, bit), 1)
    m = mixing.Mixer(n)
    m.train(words, [1] * len(words))
    # every byte after "ri": the probabilities of all 256 sum to 1 (whatever follows, so the last byte's own share is taken)
    both = m.score([b"ri" + bytes([b]) for b in range(256) if b != 32])
    nothing = m.score([b"ri"])
    after = m.score([b"ri" + bytes([b]) + b"x" for b in (97,)])
    assert 10 ** both.max() < 1 and 10 ** nothing[0] < 1 and after[0] < 0
    t, w, ctx = mixing.spelt([b"ri"])
    total = 0.0
    for b in range(256):
        p = 1.0
        for node, bit in mixing.bits(np.array([b], np.uint8)):
            q, _ = m.refined(node, m.mixed(*m.inputs([c[1:2] for c in ctx], node)))
            p *= float(q[0] if bit[0] else 1 - q[0])
        total += p
    assert math.isclose(total, 1, rel_tol=1e-5)


def test_neighbours_are_exact_where_all_are_candidates_and_near_it_elsewhere(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[5:25] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(2)
    v = neighbours.valid(df)
    got = neighbours.nearest(v, v.where("vec_id % 100 = 0")).toPandas()
    hit = 0
    y = x.astype(float)
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(y)), d)) if i != q][:10]
        part = part.sort_values("rank")
        hit += len(set(want) & set(part.vec_id))
        assert part["rank"].tolist() == list(range(1, 11)) and np.allclose(part.score, d[part.vec_id]) and (np.diff(part.score) >= 0).all()
        if q == 0:
            assert part.vec_id.tolist() == want
    assert hit >= 0.9 * 300


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    v = neighbours.valid(df)
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5), (0, 2, 100), (100, 1, 5), (100, 2, 0)]
    assert neighbours.nearest(*(neighbours.valid(df.limit(0)),) * 2).count() == 0


def brute_tiles(a, b, k):
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return out
        for m in range(n):
            used_a[i + m] = used_b[j + m] = True
        out.append(best)


@pytest.mark.parametrize("seed", range(6))
def test_tiles_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(0, 6, 40).astype(np.uint64)
    doc = np.concatenate([rng.integers(0, 6, 15), item[20:35], rng.integers(0, 6, 9), item[:18], item[5:25]]).astype(np.uint64)
    k = 4
    pairs = [(i, j) for i in range(len(doc) - k + 1) for j in range(len(item) - k + 1) if (doc[i : i + k] == item[j : j + k]).all()]
    at, on = (np.array(z) for z in zip(*pairs))
    got = tiling.tiles(doc, item, at, on, k)
    assert all((doc[d : d + n] == item[i : i + n]).all() for d, i, n in got)
    assert abs(sum(n for _, _, n in got) - sum(n for n, _, _ in brute_tiles(doc.tolist(), item.tolist(), k))) <= k


def test_reordered_passages_are_caught(spark, make, odd, empty):
    item = prose(77, 60).split()
    moved = " ".join(item[40:] + ["zzz"] + item[20:40] + ["qqq"] + item[:20])
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (None, "x"), (3, ""), (4, "short one")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    docs = make([prose(1, 100) + " " + moved.upper() + " " + prose(2, 50), prose(3, 200), " ".join(item[:20]), "", None])
    for block in (10**6, 30):
        got = tiling.contaminated(docs, items, block_words=block).collect()
        assert [(r.doc_id, r.item_id, r.n_tiles) for r in got] == [(0, 1, 3)] and got[0].coverage > 0.95
    assert tiling.contaminated(odd, items).count() == 0 and tiling.contaminated(empty, items).count() == 0
    assert tiling.contaminated(docs, items.limit(0)).count() == 0


def test_crc_is_that_of_the_id_as_text(spark):
    from panelforge.llm.common import crc_mod

    got = spark.range(50).select("id", crc_mod("id", 7).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 7 for r in got)


@pytest.mark.parametrize("seed", range(8))
def test_tiles_are_those_of_brute_force_and_any_chunks_of_seeds_give_them(seed, monkeypatch):
    rng = np.random.default_rng(50 + seed)
    item = rng.integers(0, 5, 36)
    doc = np.concatenate([rng.integers(0, 5, 15), item[20:35], rng.integers(0, 5, 9), item[:18], item[5:25]])
    words = [f"w{i}" for i in range(5)]
    want = brute_tiles(doc.tolist(), item.tolist(), 5)
    covered = sum(n for n, _, _ in want)
    for pairs in (3, 10**6):
        monkeypatch.setattr(tiling, "PAIRS", pairs)
        held = tiling.Items([(7, " ".join(words[i] for i in item))], 5)
        got = list(held.found(tiling.WordHasher()([words[i] for i in doc]), 0.01))
        assert [(g[0], round(g[1] * len(item)), g[2]) for g in got] == [(7, covered, len(want))]


def test_short_items_are_found_as_a_whole_and_repetition_stays_bounded(spark, make):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "omega"), (3, " ".join(["x"] * 500))], "item_id long, text string")
    docs = make(["zz Alpha, beta gamma delta!", "alpha beta delta gamma", "an omega", " ".join(["x"] * 20_000)])
    got = {(r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in tiling.contaminated(docs, items).collect()}
    assert got == {(0, 1, 1.0, 1), (2, 2, 1.0, 1), (3, 3, 1.0, 1)}


def test_bounds_are_quantiles_of_the_beta_distribution(spark):
    def quantile(a, b):
        t = np.linspace(-60 / min(a, b, 1) - 5, 60 / min(a, b, 1) + 5, 400_001)
        w = a * t - (a + b) * np.logaddexp(0, t)
        w = np.exp(w - w.max())
        return 1 / (1 + np.exp(-np.interp(0.95, (np.cumsum(w) - w / 2) / w.sum(), t)))

    cases = [(0.49, 2.51), (0.05, 1.0), (1.0, 1.0), (3.0, 7.0), (30.0, 300.0), (600.0, 400.0), (5.0, 0.3)]
    got = reputation.with_upper_bound(spark.createDataFrame([*cases, (0.0, 2.0), (2.0, 0.0)], "a double, b double")).collect()
    for r in got[:-2]:
        assert abs(r.bound - quantile(r.a, r.b)) < 5e-4
    assert [r.bound for r in got[-2:]] == [0.0, 1.0]


def test_shared_folder_is_needed_on_a_cluster_and_unsettled_components_raise(spark):
    from panelforge.llm.common import components

    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), most_rounds=1)


def test_the_mixer_is_fitted_on_every_token_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FIT_ROWS", 200)
    rows = [(bytearray(f"w{i}", "ascii"), 1 + 200_000 // (i + 1)) for i in range(1000)]
    words = spark.createDataFrame(rows, "word binary, c long")
    models = []
    for _ in range(2):
        m = mixing.Mixer(mixing.counted(words, 77))
        seen = mixing.fitted(words, len(rows), 77, m)
        assert seen == 8 * (sum(c * (len(w) + 1) for w, c in rows) + 77)
        models.append(m)
    assert (models[0].weights == models[1].weights).all() and (models[0].map == models[1].map).all()


def test_mixer_takes_its_inputs_from_tables_of_log_odds():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(1, 9, 300)]
    counts = rng.integers(0, 40, (int(mixing._offsets[-1]), 2)).astype(np.float32)
    model, text_word_contexts = mixing.Mixer(counts), mixing.spelt(words)
    text, _, contexts = text_word_contexts
    for node, bit in mixing.bits(text):
        for held in (None, bit):
            odds, gate = model.inputs(contexts, node, held)
            seen = []
            for k, s in enumerate(mixing.slots(contexts, node)):
                n0, n1 = counts[s].T
                if held is not None:
                    n0, n1 = np.maximum(n0 - (held == 0), 0), np.maximum(n1 - (held == 1), 0)
                assert np.allclose(odds[k], np.log((n1 + mixing.PRIOR) / (n0 + mixing.PRIOR)), atol=1e-6)
                seen.append(np.minimum(np.log2(n0 + n1 + 1), 7).astype(int))
            assert (gate == seen[5] * 8 + seen[4]).all()
    made = model.tables.made
    assert model.tables() is made  # no logarithm is taken twice
    assert len(pickle.dumps(model)) < 200_000 and len(pickle.dumps(model.tables)) < counts.nbytes + 1000  # and none is sent


def test_every_byte_of_a_text_is_spelt_once_and_its_contexts_run_over_words():
    import pyarrow as pa

    texts = [b"The  river\tis a b\nStone, x", b"", b" \n", b"a", b"ab abc abcd \x00 z"]
    t = mixing.Tokens(pa.array(texts, pa.binary()))
    words = iter(t.word)
    got = [[] for _ in texts]
    for text, end, start in zip(t.text, t.end, t.start):
        items = [mixing.start_item(int(start)), None if end else mixing.rest_item(t.kinds[int(next(words))].as_py())]
        b, _, contexts = mixing.spelt([i for i in items if i])
        got[text] += zip(b.tolist(), *(c.tolist() for c in contexts))
    for text, rows in zip(texts, got):
        stream = mixing.START + b"".join(w + b" " for w in text.lower().split()) + b" "
        assert bytes(r[0] for r in rows) == stream[4:]
        words = [m for m in stream[4:-1].split(b" ")[:-1]] + [b""]
        own = np.concatenate([mixing.spelt([w])[2][5] for w in words]).tolist()
        for i, r in enumerate(rows):
            before = stream[:4 + i]
            here = mixing.spelt([b" " + before[-4:] + stream[4 + i : 5 + i]])[2]
            assert [r[1 + k] for k in range(5)] == [c[0] for c in here[:5]]
            assert all((r[1 + k] != mixing.spelt([b" " + b"~" * (5 - k) + before[-k:][1:] + stream[4 + i : 5 + i]])[2][k][0]) for k in range(1, 5))
            assert r[6] == own[i]
    assert t.size.tolist() == [len(b"".join(w + b" " for w in x.split())) + 1 for x in texts]


def test_the_order_of_words_counts(make):
    docs = make([" ".join(["stone river", "lamp glass", "river lamp"][(i * 7 + j) % 3] for j in range(40)) for i in range(30)] + ["stone river lamp glass", "glass lamp river stone"])
    got = {r.doc_id: r for r in mixing.lm_scores(docs, F.col("doc_id") < 30).collect()}
    assert math.isclose(got[30].base_score, got[31].base_score, rel_tol=1e-9) and got[30].score > got[31].score + 0.5
