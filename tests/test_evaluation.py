"""Sizes, models and periods as runs of one plan, against a loop over each; the command line."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge import cli
from panelforge.operators import backtest, combine, evaluation, metrics
from panelforge.operators.zoo import Member, Zoo
from panelforge.plans.templates import formula_of
from panelforge.sources import panel as P

SHAPES = ("pressure", "reversal", "calm")


@pytest.fixture(scope="module")
def panel(spark):
    """A synthetic panel with industries, sizes and a universe that changes, kept."""
    p = P.synthetic_panel(spark, instruments=18, days=110).withColumns({"fwd": P.forward_return(4), "ret1": P.forward_return(1)})
    return p.withColumns({
        "industry": F.concat(F.lit("i"), F.col("inst_ord") % 3), "log_mv": F.ln("volume"),
        "in_universe": (F.col("inst_ord") + F.floor(F.col("date_idx") / 40)) % 6 != 0,
    }).cache()


@pytest.fixture(scope="module")
def parts(panel):
    f = evaluation.features(panel, {s: formula_of(s).tree(formula_of(s).arguments[0]) for s in SHAPES}).cache()
    m = evaluation.market(panel, panel.select("date_idx", "instrument", P.daily_return().alias("ret"))).cache()
    return f, m


PERIODS = {"valid": (60, 84), "test": (85, 109)}


def test_features_are_of_members_only(panel, parts):
    f, m = parts
    out = f.join(panel.select("date_idx", "instrument", "in_universe"), ["date_idx", "instrument"])
    assert out.where("not in_universe and (value <> 0 or fwd is not null)").count() == 0
    assert out.where("in_universe and value <> 0").count() > 1000
    assert m.where("open").count() == panel.where("in_universe and close is not null").count()


def test_kept_features_are_combined_without_an_exchange(panel):
    f = evaluation.features(panel, {s: formula_of(s).tree(formula_of(s).arguments[0]) for s in SHAPES}).persist()
    f.count()
    for out in (combine.equal_weight(f), combine.table(f, list(SHAPES)), f.withColumn("r", metrics.cs_rank("value"))):
        out.count()
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    f.unpersist()


def test_all_runs_equal_each_on_its_own(parts):
    f, m = parts
    for mode in ("periodic", "topk_dropn"):
        pred = evaluation.combined(f, SHAPES, [2, 3, 9], ["equal", "ewma"], 59, 4, halflife=10, least=10)
        got = {(r.model, r.size, r.period): r for r in evaluation.evaluate(pred, m, PERIODS, 4, mode, share=0.2, cost=0.001).collect()}
        assert set(got) == {(a, n, p) for a in ("equal", "ewma") for n in (2, 3) for p in PERIODS}
        for (model, n, period), r in got.items() if mode == "periodic" else list(got.items())[:3]:
            own = f.where(F.col("factor_id").isin(list(SHAPES[:n])))
            alone = combine.combine(model, own, list(SHAPES[:n]), 59, 4, halflife=10, least=10)
            a, b = PERIODS[period]
            cut = alone.where(F.col("date_idx").between(a, b)).join(m.select("date_idx", "instrument", "open", "fwd"), ["date_idx", "instrument"]).withColumn("pred", F.when(F.col("open"), F.round("pred", evaluation.PLACES))).cache()
            ic = metrics.daily_rank_ic(cut.withColumn("factor_id", F.lit("x")).withColumnRenamed("pred", "value")).agg(F.avg("ic")).first()[0]
            test = backtest.periodic if mode == "periodic" else backtest.top_k_drop_n
            done = backtest.summary(test(cut.drop("fwd"), m, 4, 0.2, 0.001)).first()
            assert r.rank_ic == pytest.approx(ic, abs=1e-9) and r.days == done.days == b - a
            assert r.aer == pytest.approx(done.aer, abs=1e-9) and r.ir == pytest.approx(done.ir, abs=1e-9)
            cut.unpersist()


def test_weights_by_period_equal_those_of_each_set(parts):
    f, _ = parts
    got = {(r.size, r.period, r.factor_id): (r.mean_weight, r.paused) for r in evaluation.weights_by_period(f, SHAPES, [2, 3], PERIODS, 4, 10, 10).collect()}
    for n in (2, 3):
        w = combine.ewma_weights(f.where(F.col("factor_id").isin(list(SHAPES[:n]))), 10, 10, 4).toPandas()
        for period, (a, b) in PERIODS.items():
            part = w[w.date_idx.between(a, b)].groupby("factor_id").weight
            for s in SHAPES[:n]:
                assert got.pop((n, period, s)) == pytest.approx((part.mean()[s], (part.get_group(s) <= 1e-12).mean()))
    assert not got


def test_drop_n_folds_only_what_can_be_held(spark):
    """Of 400 names, ten can be within the first k + n on any date; the others don't reach the fold."""
    rng = np.random.default_rng(8)
    rows = [(i, f"d{j:03d}", j, float(rng.normal() + (20 if j < 10 else 0)), float(rng.normal() / 100)) for i in range(40) for j in range(400)]
    df = spark.createDataFrame(rows, "date_idx int, instrument string, inst_ord int, pred double, ret double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("date_idx")))
    pred, returns = df.drop("ret"), df.select("date_idx", "instrument", "ret").withColumn("bench", F.col("ret"))
    out = backtest.top_k_drop_n(pred, returns, 4, 0.015, 0.001)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    p = pd.DataFrame(rows, columns=["i", "s", "j", "pred", "ret"])
    k, n = backtest.book_size(pred, 0.015, 4)
    held, due, want = [], 0.0, []
    for i, day in p.groupby("i"):
        ret = day.set_index("s").ret
        if i:
            want.append(ret[held].mean() - ret.mean() - due)
            due = 0.0
        ranked = day.sort_values("pred", ascending=False).s.tolist()
        if not held:
            held, due = ranked[:k], 0.001
            continue
        sells = [s for s in sorted(held, key=ranked.index, reverse=True) if s not in ranked[:k]][:n]
        buys = [s for s in ranked if s not in held][: len(sells)]
        held, due = [s for s in held if s not in sells] + buys, 0.001 * 2 * len(sells) / k
    np.testing.assert_allclose(out.orderBy("date_idx").toPandas().excess, want, atol=1e-12)


def test_report_of_an_evaluation(spark, panel, tmp_path, monkeypatch, capsys):
    zoo = Zoo(members=[Member(s, formula_of(s).text(formula_of(s).arguments[0]), formula_of(s).to_json(), formula_of(s).arguments[0], {"rank_ir": float(i)}) for i, s in enumerate(SHAPES)])
    zoo.save(str(tmp_path / "zoo.json"))
    monkeypatch.setattr(cli, "session", lambda **_: spark)
    monkeypatch.setattr(P, "load_panel", lambda *_, **__: panel.drop("fwd", "ret1"))
    cli.main(["evaluate", "--out", str(tmp_path), "--sizes", "2,all", "--models", "equal,ewma", "--mode", "periodic", "--horizon", "4"])
    report = json.loads((tmp_path / "evaluation.json").read_text())
    assert len(report["per_alpha"]) == 3 and len(report["combiner"]) == 4 and len(report["ewma_weights"]) == 5
    assert {r["size"] for r in report["combiner"]} == {2, 3} and json.loads(capsys.readouterr().out.splitlines()[-1]) == report["combiner"]
    cli.main(["rescreen", "--out", str(tmp_path), "--strict-out", str(tmp_path / "strict"), "--horizon", "4"])
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert told["of"] == 3 and told["kept"] == len(Zoo.load(str(tmp_path / "strict/zoo.json")).members)
