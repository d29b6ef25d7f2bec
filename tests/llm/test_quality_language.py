import random

import numpy as np
from pyspark.sql import functions as F

from panelforge.llm import language
from panelforge.llm.quality import Discriminant, fit, quality_scores, statistics, with_statistics
from tests.llm.conftest import prose


def labelled(make):
    docs = make([prose(i, 80 + i) if i % 4 else " ".join(w.upper() + "!!" for w in prose(i, 60).split()) for i in range(200)])
    return docs, docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))


def test_held_out_accuracy(make):
    docs, labels = labelled(make)
    got = quality_scores(docs, labels.where("doc_id < 120")).join(labels, "doc_id").where("doc_id >= 120")
    assert got.where((F.col("score") >= 0.5) == (F.col("quality") == 1)).count() == 80


def test_sums_match_numpy(make):
    docs, labels = labelled(make)
    model = fit(with_statistics(docs), labels, 0.1)
    x = np.array([statistics(r.text.encode()) for r in docs.orderBy("doc_id").collect()])
    y = np.arange(200) % 4 != 0
    want = Discriminant([50, 150], [x[~y].mean(0), x[y].mean(0)], [np.cov(x[k].T, bias=True) for k in (~y, y)], 0.1)
    np.testing.assert_allclose(model.margin(x), want.margin(x), rtol=1e-6, atol=1e-6)
    low = want.factor[1]
    s = np.linalg.inv(low.T @ low)
    d = x[0] - want.mean[1]
    assert np.isclose(((low @ d) ** 2).sum(), d @ np.linalg.solve(s, d))


def test_odd_rows_get_scores(make, odd, empty):
    _, labels = labelled(make)
    got = quality_scores(odd, labels.withColumn("toxic", F.lit(0)))
    assert got.count() == odd.count() and got.where("score is null or isnan(score)").count() == 0
    assert quality_scores(empty, labels).count() == 0
    assert quality_scores(odd, labels.limit(0)).where("score <> 1").count() == 0


def greedy(text, learnt):
    """Longest-match phrases by plain search."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in learnt:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_automaton_counts_longest_matches():
    texts = {"a": "the cat sat on the mat and the rat", "b": "el gato come pan en la casa del mar"}
    m = language.Model(texts)
    for t in ("the pan sat en the gato", "zzz the qqq", "mat", "casa del mar casa del mar"):
        c = m.coded(t)
        got = m.phrases(c[:, None], np.array([len(c)]))[:, 0]
        want = [greedy("".join(map(chr, c)), "".join(map(chr, m.coded(texts[k])))) for k in m.langs]
        assert got.tolist() == want, t


def test_languages(make, odd, empty):
    es = "el la de que y en un ser se no haber por con su para como estar tener le lo todo".split()
    rng = np.random.default_rng(0)
    texts = [prose(i, 120) if i % 2 else " ".join(rng.choice(es, 120)) for i in range(60)]
    docs = make(texts, ["en" if i % 2 else "es" for i in range(60)])
    model = language.learn(docs.where("doc_id < 40"))
    got = language.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id >= 40")
    assert got.where("lang = lang_pred").count() == 20
    out = {r.doc_id: r for r in language.identified(odd, model).where("doc_id is not null").collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 5)) and out[7].lang_pred in ("en", "es")
    assert language.identified(odd, model).count() == odd.count() and language.identified(empty, model).count() == 0
    assert language.identified(odd, language.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_lanes_do_not_change_results():
    rng = random.Random(3)

    def made(n, letters):
        return "".join(rng.choice(letters) for _ in range(n))

    m = language.Model({"a": made(3000, "abc "), "b": made(3000, "abd e"), "c": "ab" * 500})
    codes = [m.coded(t) for t in [*(made(rng.randint(0, 900), "abcde x1") for _ in range(40)), "ab" * 1000, "", "a", "zzz"]]
    whole = m.parsed(codes, 10**9)
    for lane in (1, 2, 8, 64, 512):
        assert (m.parsed(codes, lane) == whole).all()


def test_texts_that_are_parsed_again_go_side_by_side(monkeypatch):
    """Phrases that don't meet within a lane cost no pass of their own for each text, and none at all where the text ends."""
    m = language.Model({"c": "ab" * 500})
    codes = [m.coded("ab" * n) for n in (300, 400, 500, 600, 700)]
    whole = m.parsed(codes, 10**9)
    calls, starts = [], language.Model.starts
    monkeypatch.setattr(language.Model, "starts", lambda self, a, lanes, many: calls.append(lanes.shape) or starts(self, a, lanes, many))
    assert (m.parsed(codes, 1024) == whole).all() and len(calls) == 1
    calls.clear()
    assert (m.parsed(codes, 101) == whole).all() and len(calls) <= 4
