"""Likeness from one table, admission in sequence, re-screening, kept values and parallel trees, against loops."""

import json
import math
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import metrics, robustness
from panelforge.operators.gram import LEAST_CELLS, gram
from panelforge.operators.zoo import Criteria, Member, Zoo
from panelforge.plans.templates import formula_of
from panelforge.search import tree
from panelforge.search.proposer import TemplateProposer
from panelforge.search.store import ValueStore, fingerprint, key_of
from panelforge.sources import panel as P

DAYS, NAMES, FACTORS = 50, 30, ("a", "b", "c", "d", "e")
ROWS = "factor_id string, date_idx int, inst_ord int, instrument string, value double"


@pytest.fixture(scope="module")
def frames():
    """Five factors with gaps of their own, ties, one constant day; c is near a + b, e repeats a."""
    rng = np.random.default_rng(12)
    a, b, d = (pd.DataFrame(rng.normal(size=(DAYS, NAMES)).round(1)) for _ in range(3))
    c = 0.7 * a + 0.6 * b + 0.1 * d
    out = dict(zip(FACTORS, (a, b, c, d, a.copy())))
    for i, f in enumerate(out.values()):
        f[pd.DataFrame(rng.random((DAYS, NAMES)) < 0.05 * i)] = np.nan
    out["b"].iloc[7] = 1.0
    out["d"].iloc[:9] = np.nan
    return out


@pytest.fixture(scope="module")
def values(spark, frames):
    rows = [(f, i, j, f"n{j}", None if np.isnan(x) else float(x)) for f, v in frames.items() for i, day in enumerate(v.to_numpy()) for j, x in enumerate(day)]
    df = spark.createDataFrame(rows, ROWS)
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("date_idx"))).cache()


def ranks(frame):
    return frame.rank(axis=1, pct=True)


def mean_corr(x, y):
    daily = []
    for i in x.index:
        ok = x.loc[i].notna() & y.loc[i].notna()
        if ok.sum() >= 3 and min(x.loc[i][ok].std(), y.loc[i][ok].std()) > 1e-9:
            daily.append(x.loc[i][ok].corr(y.loc[i][ok]))
    return np.mean(daily)


def refitted(frames, candidate, pool):
    """The regression done over again on whole matrices."""
    split = int(DAYS * 0.6)
    y = (ranks(frames[candidate]) - 0.5).to_numpy()
    x = np.stack([(ranks(frames[p]) - 0.5).fillna(0.0).to_numpy() for p in pool], -1)
    part = lambda s: (x[s][~np.isnan(y[s])], y[s][~np.isnan(y[s])])
    (x0, y0), (x1, y1) = part(slice(0, split)), part(slice(split, DAYS))
    beta = np.linalg.solve(x0.T @ x0 + 1e-4 * np.eye(len(pool)), x0.T @ y0)
    return 1 - ((y1 - x1 @ beta) ** 2).sum() / ((y1 - y1.mean()) ** 2).sum()


def test_correlations_are_those_of_each_pair(values, frames):
    g = gram(values, FACTORS, [])
    for a in FACTORS:
        for b in FACTORS:
            assert g.correlation(a, b) == pytest.approx(mean_corr(ranks(frames[a]), ranks(frames[b])), abs=1e-12)
    known = {(r.factor_id, r.other_id): r["corr"] for r in metrics.factor_correlation(values.where("factor_id <> 'b'")).collect()}
    assert len(known) == 6 and all(g.correlation(a, b) == pytest.approx(c, abs=1e-12) for (a, b), c in known.items())
    assert g.max_corr("c", ["a", "d"]) == max(abs(g.correlation("c", "a")), abs(g.correlation("c", "d"))) and g.max_corr("c", []) == 0.0


@pytest.mark.parametrize("candidate", FACTORS)
def test_reconstruction_from_any_pool_equals_refitting(values, frames, candidate):
    g = gram(values, FACTORS)
    others = [f for f in FACTORS if f != candidate]
    for pool in (others, others[:1], others[1:3], others[::-1][:3]):
        assert g.recon_r2(candidate, pool) == pytest.approx(refitted(frames, candidate, pool), abs=1e-9), pool
    assert g.recon_r2(candidate, []) is None
    assert robustness.reconstruction_r2(values, candidate, others[:2]) == pytest.approx(refitted(frames, candidate, others[:2]), abs=1e-9)


def test_too_little_gives_nothing(spark, values):
    g = gram(values.where("date_idx < 15"), ["a", "b"])
    assert g.recon_r2("a", ["b"]) is None and g.correlation("a", "b") is not None  # six dates to test on
    few = gram(values.where(f"inst_ord < {LEAST_CELLS // 25}"), ["a", "b"])
    assert few.recon_r2("a", ["b"]) is None
    none = gram(values.limit(0), ["a", "b"])
    assert none.correlation("a", "b") is None and none.recon_r2("a", ["b"]) is None and none.max_corr("a", ["b"]) == 0.0
    missing = gram(values, ["a", "nowhere"])
    assert missing.correlation("a", "nowhere") is None and missing.recon_r2("nowhere", ["a"]) is None


def test_one_job_whatever_the_number_of_candidates(spark, values):
    def jobs(names):
        spark.sparkContext.setJobGroup(f"g{len(names)}", "")
        gram(values, names, dates=(0, DAYS - 1))
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"g{len(names)}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(found)

    assert jobs(FACTORS) == jobs(FACTORS[:2])


def test_members_are_taken_in_turn(values, frames):
    g = gram(values, FACTORS)
    z = Zoo(Criteria(min_rank_ic=-1, min_rank_ir=-1, max_rel_rank=1.01, max_correlation=0.95, max_recon_r2=0.8))
    told = {f: z.offer(Member(f, f, {}, {}, {"rank_ic": 0.0, "rank_ir": 0.0}), g) for f in ("a", "d", "b", "c", "e", "a")}
    assert told == {"a": ["duplicate"], "d": [], "b": [], "c": ["recon"], "e": ["max_corr", "recon"]}
    # without b, c is something new
    z = Zoo(z.criteria)
    assert [z.offer(Member(f, f, {}, {}, {"rank_ic": 0.0, "rank_ir": 0.0}), g) for f in ("a", "d", "c")] == [[], [], []]
    assert z.members[2].metrics["recon_r2"] == pytest.approx(refitted(frames, "c", ["a", "d"]), abs=1e-9)


def test_upper_tail(spark):
    xs = [-9.0, -7.2, -3.3, -1.0, -1e-3, 0.0, 0.5, 1.96, 4.0, 4.9, 7.0, 7.1, 12.0, 30.0, None]
    for x, got in spark.createDataFrame([(x,) for x in xs], "t double").select("t", robustness.upper_tail(F.col("t"))).collect():
        assert got == pytest.approx(1.0 if x is None else 0.5 * math.erfc(x / math.sqrt(2)), rel=1e-6 if x and x > 5 else 1e-13)


def search_panel(spark, instruments=14, days=140):
    p = P.synthetic_panel(spark, instruments=instruments, days=days)
    return p.withColumns({"fwd": P.forward_return(5), "ret1": P.forward_return(1)})


def test_store_evaluates_only_what_is_new(spark, tmp_path):
    panel = search_panel(spark).cache()
    store = ValueStore(str(tmp_path), panel, tree.prepared)
    trees = {s: formula_of(s).tree(formula_of(s).arguments[0]) for s in ("pressure", "reversal", "calm")}
    first = {s: trees[s] for s in ("pressure", "reversal")}
    sort = lambda df: sorted(map(tuple, df.select("factor_id", "date_idx", "inst_ord", "value", "fwd", "ret1").collect()), key=str)
    assert sort(store.values(first)) == sort(tree.prepared(panel, first))
    assert set(store.computed) == {t.text for t in first.values()}
    assert sort(store.values(trees | {"again": trees["calm"]})) == sort(tree.prepared(panel, trees | {"again": trees["calm"]}))
    assert store.computed[2:] == [trees["calm"].text]
    later = ValueStore(str(tmp_path), panel.repartition(3), tree.prepared)  # another run over the same panel
    assert sort(later.values(trees)) == sort(tree.prepared(panel, trees)) and later.computed == []
    other = ValueStore(str(tmp_path), panel.where("date_idx > 3"), tree.prepared)
    other.values(first)
    assert len(other.computed) == 2 and other.path != store.path and fingerprint(panel) == fingerprint(panel.orderBy("close"))


def test_a_write_that_was_cut_short_or_done_twice_does_no_harm(spark, tmp_path):
    panel = search_panel(spark).cache()
    store = ValueStore(str(tmp_path), panel, tree.prepared)
    one = {"p": formula_of("pressure").tree(formula_of("pressure").arguments[0])}
    key = key_of(one["p"])
    n = store.values(one).count()
    whole = tree.prepared(panel, {key: one["p"]}).withColumnRenamed("factor_id", "key")
    whole.limit(5).write.partitionBy("key").parquet(f"{store.path}/values/batch=0000")  # not in the list
    assert store.values(one).count() == n
    whole.write.partitionBy("key").parquet(f"{store.path}/values/batch=00")
    spark.createDataFrame([(key, "p")], "key string, text string").write.parquet(f"{store.path}/contents/batch=00")
    assert store.values(one).count() == n


def test_a_second_step_of_the_search_reads_members_and_earlier_candidates(spark, tmp_path):
    panel, split = search_panel(spark).cache(), tree.Split.at(140)
    store = ValueStore(str(tmp_path), panel, tree.prepared)
    pressure, calm = formula_of("pressure"), formula_of("calm")
    first = tree.evaluate(panel, [pressure], Zoo(), 5, split, store=store)[0]
    z = Zoo(members=[tree.as_member(first)])
    seen = len(store.computed)
    assert seen == len(pressure.arguments)
    second = tree.evaluate(panel, [pressure, calm], z, 5, split, store=store)
    assert store.computed[seen:] == [calm.tree(a).text for a in calm.arguments]
    plain = tree.evaluate(panel, [pressure, calm], z, 5, split)
    for a, b in zip(second, plain):
        assert a.metrics == pytest.approx(b.metrics, nan_ok=True) and a.metrics["max_corr"] is not None
    assert second[0].metrics["max_corr"] == pytest.approx(1.0)
    before = len(store.computed)
    tree.admit(panel, second, z, split, store)
    assert len(store.computed) == before


OPEN = Criteria(min_rank_ic=-1, min_rank_ir=-99, max_turnover=3, max_correlation=0.9, max_rel_rank=1.01, max_hac_pvalue=1.0, max_control_ic=1.0, min_block_frac=0.0, min_year_frac=0.0, max_recon_r2=0.9, min_q_spread=-9.0, min_ls_sharpe=-99.0)


def test_parallel_trees_overlap_and_keep_the_books(spark, tmp_path):
    panel, split = search_panel(spark).cache(), tree.Split.at(140)
    running, most, lock = set(), [], threading.Lock()

    class Watched(tree.Search):
        def tree(self, number, budget, most_budget):
            with lock:
                running.add(number)
                most.append(len(running))
            try:
                if number == 1:
                    raise RuntimeError("this tree fails")
                return super().tree(number, budget, most_budget)
            finally:
                with lock:
                    running.discard(number)

    checkpoints, z = [], Zoo(OPEN)
    search = Watched(panel, TemplateProposer(seed=3), z, 5, split, store=ValueStore(str(tmp_path / "values"), panel, tree.prepared))
    keep = tree.saved(str(tmp_path / "run"))
    count = search.run(4, 1, 1, parallel=2, checkpoint=lambda s: (checkpoints.append(s.count.trees), keep(s)))
    assert count.trees == 3 and count.failed == 1 and checkpoints == [1, 2, 3] and max(most) == 2
    assert count.added == len(z.members) >= 1 and count.generated >= 6
    names = [m.expression for m in z.members]
    assert len(set(names)) == len(names)
    g = gram(tree.within(tree.prepared(panel, {m.expression: tree.Formula.parse(m.formula).tree(m.args) for m in z.members}), split.train), names)
    assert all(abs(g.correlation(a, b) or 0) < OPEN.max_correlation for i, a in enumerate(names) for b in names[:i])
    stats = json.loads((tmp_path / "run/stats.json").read_text())
    assert stats["trees"] == 3 and stats["zoo_size"] == len(names) and Zoo.load(str(tmp_path / "run/zoo.json")) == z

    # goes on from the saved zoo and values, and stops as soon as it is large enough
    again = Zoo.load(str(tmp_path / "run/zoo.json"))
    count = tree.mine(spark, panel, TemplateProposer(seed=9), again, 5, trees=9, budget=1, most_budget=1, split=split, stopped_at=len(names), folder=str(tmp_path / "values"))
    assert count.trees == 0 and len(again.members) == len(names)


def test_rescreening_replays_admission(spark):
    panel, split = search_panel(spark).cache(), tree.Split.at(140)
    shapes = ("reversal", "heavy_reversal", "pressure", "calm")
    old = Zoo(members=[Member(s, formula_of(s).text(formula_of(s).arguments[0]), formula_of(s).to_json(), formula_of(s).arguments[0], {"rank_ic": 0.1 - i / 100, "rank_ir": 0.1}) for i, s in enumerate(shapes)])
    strict = Criteria(min_rank_ic=-1, min_rank_ir=-99, max_correlation=0.6, max_rel_rank=0.4, max_hac_pvalue=0.95, max_control_ic=0.2, min_block_frac=0.2, min_year_frac=0.0, max_recon_r2=0.5, min_q_spread=-9.0, min_ls_sharpe=-99.0)
    for keep in (False, True):
        fresh, told = tree.rescreen(panel, old, 5, split, strict, keep_rel_rank=keep, block_least=5, year_least=5)
        # the same, one at a time, each measured for itself
        again = Zoo(strict if keep else tree.replace(strict, max_rel_rank=1.01))
        for m, (expression, reasons) in zip(old.members, told):
            pool = {x.expression: tree.Formula.parse(x.formula).tree(x.args) for x in again.members}
            values = tree.within(tree.prepared(panel, pool | {m.expression: tree.Formula.parse(m.formula).tree(m.args)}), split.train)
            row = tree.full_metrics(tree.prepared(panel, {m.expression: tree.Formula.parse(m.formula).tree(m.args)}), split, 5, 5, 5).first().asDict()
            own = m.metrics | {k: row[k] for k in tree.ROBUSTNESS}
            corr = metrics.factor_correlation(values).collect() if pool else []
            own["max_corr"] = max((abs(r["corr"]) for r in corr if m.expression in (r.factor_id, r.other_id)), default=0.0)
            own["recon_r2"] = robustness.reconstruction_r2(values, m.expression, list(pool))
            assert again.add(tree.replace(m, metrics=own)) == reasons and expression == m.expression
        assert [m.expression for m in again.members] == [m.expression for m in fresh.members]
    assert old.members[0].metrics == {"rank_ic": 0.1, "rank_ir": 0.1}


def test_context_of_a_place_has_path_siblings_children_and_exemplars(spark):
    made = lambda name, score: tree.Candidate(formula_of("reversal"), {"a": name}, {}, dict.fromkeys(tree.DIMENSIONS, score))
    root = tree.Place(made(1, 0.1))

    def below(parent, name, dimension):
        child = tree.Place(made(name, name / 10), parent, dimension=dimension)
        parent.children.append(child)
        return child

    a, b = below(root, 2, "turnover"), below(root, 3, "stability")
    c = below(a, 4, "diversity")
    below(c, 5, "turnover")
    found = tree.context_of(c, [{"expression": "E", "rank_ic": 0.05, "rank_ir": None}])
    assert [r.dimension for r in found.path] == ["turnover", "diversity"] and found.siblings == () and [r.dimension for r in found.children] == ["turnover"]
    assert tree.context_of(a).siblings == (b.refinement,) and tree.context_of(root).path == ()
    assert found.tried == {x.candidate.expression for x in (a, c, c.children[0])}
    assert "diversity 0.20 -> 0.40" in found.text and "E, rank_ic 0.0500" in found.text and tree.context_of(root).text.startswith("Tried on this formula")


def test_proposers_get_the_context_and_avoid_what_was_tried(spark):
    seen = []

    class Noting(TemplateProposer):
        def propose(self, avoid, refine=None, dimension="", context=None):
            seen.append((refine, context))
            return super().propose(avoid, refine, dimension, context)

    panel, split = search_panel(spark).cache(), tree.Split.at(140)
    one = tree.evaluate(panel, [formula_of("calm")], Zoo(), 5, split)[0]
    search = tree.Search(panel, Noting(seed=2), Zoo(OPEN, [tree.as_member(one)]), 5, split)
    found = search.tree(0, 2, 2)
    steps = [c for refine, c in seen if refine is not None]
    assert len(found) == 3 and len(steps) >= 2 and all(c is not None for c in steps) and found[0].alike.keys() == {one.expression}
    assert any(c.children or c.path for c in steps[1:])
    assert search.exemplars("diversity", found[0])[0]["expression"] == one.expression and search.exemplars("turnover", found[0]) == []
