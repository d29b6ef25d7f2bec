"""Metrics against pandas on random panels with gaps and ties."""

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.operators import backtest, combine, longshort, metrics, neutralize, robustness, zoo

DAYS, NAMES = 60, 12


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(3)
    v = pd.DataFrame(rng.normal(size=(DAYS, NAMES)).round(1))
    r = pd.DataFrame(0.4 * v + rng.normal(size=(DAYS, NAMES)))
    v.iloc[3, 2:5] = v.iloc[10, :10] = r.iloc[5, 1] = np.nan
    return v, r


@pytest.fixture(scope="module")
def values(spark, frames):
    v, r = frames
    rows = [("f", i, str(j), j, *(None if np.isnan(x) else float(x) for x in (v.iloc[i, j], r.iloc[i, j]))) for i in range(DAYS) for j in range(NAMES)]
    df = spark.createDataFrame(rows, "factor_id string, date_idx int, instrument string, inst_ord int, value double, fwd double")
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("date_idx"))).cache()


def pearson(x, y):
    ok = x.notna() & y.notna()
    return x[ok].corr(y[ok]) if ok.sum() >= 3 else np.nan


def series(df, column="ic"):
    return df.toPandas().set_index("date_idx")[column].sort_index()


def test_rank_ic_ranks_each_side_on_its_own(values, frames):
    v, r = frames
    vr, rr = v.rank(axis=1, pct=True), r.rank(axis=1, pct=True)
    want = pd.Series([pearson(vr.loc[i], rr.loc[i]) for i in v.index]).dropna()
    np.testing.assert_allclose(series(metrics.daily_rank_ic(values)).dropna(), want, atol=1e-12)


def test_ic_and_mean(values, frames):
    v, r = frames
    want = pd.Series([pearson(v.loc[i], r.loc[i]) for i in v.index])
    np.testing.assert_allclose(series(metrics.daily_ic(values)).dropna(), want.dropna(), atol=1e-12)
    row = metrics.mean_and_ir(metrics.daily_ic(values)).first()
    assert math.isclose(row.mean, want.mean()) and math.isclose(row.ir, want.mean() / want.std())


def test_top_weights_sum_to_one_on_active_days(values):
    w = metrics.top_weights(values, 0.25).groupBy("date").agg(F.sum("weight").alias("w"), F.count_if(F.col("weight") > 0).alias("n")).toPandas()
    assert np.allclose(w.w, 1) and w.n.max() == 3


def test_quantiles_cover_all_and_follow_the_signal(values):
    q = longshort.quantile_labels(values, 4).toPandas()
    full = q[q.date_idx == 0].bucket.value_counts()
    assert set(full) == {3}
    means = longshort.quantile_means(values, 4)
    m = means.orderBy("bucket").toPandas().mean_return
    assert m.iloc[-1] > m.iloc[0] and longshort.quantile_spread(means, 4).first().spread == pytest.approx(m.iloc[-1] - m.iloc[0])


@pytest.mark.parametrize("lag", [0, 3])
def test_newey_west(values, lag):
    ic = metrics.daily_rank_ic(values)
    s = series(ic).dropna().to_numpy()
    d, n = s - s.mean(), len(s)
    var = d @ d / n + sum(2 * (1 - k / (lag + 1)) * (d[k:] @ d[:-k]) / n for k in range(1, lag + 1))
    t = s.mean() / math.sqrt(var / n)
    row = robustness.newey_west(ic, lag).first()
    assert row.t == pytest.approx(t) and row.p == pytest.approx(0.5 * math.erfc(t / math.sqrt(2)))


def test_newey_west_of_a_short_series(spark):
    s = spark.sql("select 'f' factor_id, date'2020-01-01' date, 0 date_idx, 0.1D ic union all select 'f', date'2020-01-02', 1, 0.2D")
    row = robustness.newey_west(s, 4).first()
    assert row.t is None and row.p == 1.0


def test_blocks_are_even_splits(values):
    ic = metrics.daily_rank_ic(values)
    s = series(ic).dropna().to_numpy()
    want = np.mean([b.mean() > 0 for b in np.array_split(s, 4)])
    assert robustness.block_fraction(ic, 4, 10).first().fraction == want
    assert robustness.block_fraction(ic, 4, 1000).first().fraction is None


def test_a_factor_reconstructs_itself(values):
    both = values.unionByName(values.withColumn("factor_id", F.lit("g")))
    assert robustness.reconstruction_r2(both, "f", ["g"]) > 0.999
    assert robustness.reconstruction_r2(both, "f", []) is None


def test_neutralize_leaves_no_industry_mean_and_no_size_slope(values):
    df = values.withColumn("industry", F.when(F.col("inst_ord") < 5, "a").when(F.col("inst_ord") < 10, "b").otherwise(""))
    df = df.withColumn("log_mv", F.col("inst_ord") * 0.3 + F.sin(F.col("date_idx").cast("double")))
    out = neutralize.neutralize(df).toPandas()
    out["industry"] = out.industry.replace("", "UNK")
    assert abs(out.groupby(["date", "industry"]).value.mean().dropna()).max() < 1e-9
    assert out.value.isna().sum() == values.where("value is null").count()


def test_ewma_weights_use_no_future(spark, values):
    two = values.unionByName(values.withColumn("factor_id", F.lit("g")).withColumn("value", -F.col("value")))
    f = combine.rank_normalized(two)
    changed = f.withColumn("fwd", F.when(F.col("date_idx") >= 40, -F.col("fwd")).otherwise(F.col("fwd")))
    before, after = (combine.ewma_weights(x, 10, 10, 2).where("date_idx < 43").orderBy("factor_id", "date_idx").toPandas() for x in (f, changed))
    pd.testing.assert_frame_equal(before, after)
    assert np.allclose(before.groupby("date_idx").weight.sum(), 1) and before.weight[before.date_idx > 20].nunique() > 1


def test_ewma_weights_match_pandas(values):
    f = combine.rank_normalized(values.unionByName(values.withColumn("factor_id", F.lit("g")).withColumn("value", F.col("value") * F.col("inst_ord"))))
    ic = metrics.daily_rank_ic(f).toPandas().pivot(index="date_idx", columns="factor_id", values="ic").reindex(range(DAYS))
    raw = ic.ewm(halflife=10, min_periods=10).mean().shift(3).clip(lower=0)
    total = raw.sum(axis=1)
    want = raw.div(total.where(total > 0), axis=0).fillna(0.5)
    got = combine.ewma_weights(f, 10, 10, 2).toPandas().pivot(index="date_idx", columns="factor_id", values="weight")
    np.testing.assert_allclose(got, want, atol=1e-9)


def trades(values):
    pred = values.select("date", "date_idx", "instrument", "inst_ord", F.col("value").alias("pred"))
    returns = values.select("date", "date_idx", "instrument", (F.col("fwd") / 100).alias("ret")).withColumn("bench", F.col("ret"))
    return pred, returns


def test_periodic_backtest_matches_a_loop(values):
    pred, returns = trades(values)
    p, r = pred.toPandas().sort_values(["date_idx", "inst_ord"]), returns.toPandas()
    k, h, cost = max(1, round(0.2 * int(p.groupby("date_idx").pred.count().median()))), 3, 0.01
    held, due, want = [], 0.0, []
    for i in range(DAYS):
        day = r[r.date_idx == i].set_index("instrument").ret
        if i:
            bench = day.mean()
            port = day.reindex(held).mean() if held else 0.0
            want.append((bench if np.isnan(port) else port) - bench - due)
            due = 0.0
        scores = p[(p.date_idx == i)].dropna(subset=["pred"]).sort_values("pred", ascending=False, kind="stable").instrument.tolist()
        if i % h == 0 and scores:
            target = scores[:k]
            due = cost if not held else cost * 2 * len(set(held) - set(target)) / len(target)
            held = target
    got = backtest.periodic(pred, returns, h, 0.2, cost).orderBy("date_idx").toPandas().excess
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_drop_n_costs_lower_the_result(values):
    pred, returns = trades(values)
    free, dear = (backtest.summary(backtest.top_k_drop_n(pred, returns, 3, 0.2, c)).first().aer for c in (0.0, 0.01))
    assert free > dear and free > 0


def test_drop_n_matches_a_loop_and_holds_one_date(values):
    pred, returns = trades(values)
    runs = pred.withColumn("run_id", F.lit("a")).unionByName(pred.withColumn("run_id", F.lit("b")).withColumn("pred", F.when(F.col("date_idx") % 4 != 1, -F.col("pred"))))
    h, cost = 3, 0.01
    df = backtest.top_k_drop_n(runs, returns, h, 0.2, cost)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "MapInArrow" in plan  # no group of a whole run
    k, n = backtest.book_sizes(runs, 0.2, h)["a"]  # of one run, as the other has as many
    got = df.orderBy("run_id", "date_idx").toPandas()
    r, want = returns.toPandas(), []
    for _, p in runs.toPandas().sort_values(["date_idx", "inst_ord"]).groupby("run_id"):
        held, due = [], 0.0
        for i in range(DAYS):
            day = r[r.date_idx == i].set_index("instrument").ret
            if i:
                bench = 0.0 if np.isnan(day.mean()) else day.mean()
                port = day.reindex(held).mean() if held else 0.0
                want.append((bench if np.isnan(port) else port) - bench - due)
                due = 0.0
            ranked = p[p.date_idx == i].dropna(subset=["pred"]).sort_values("pred", ascending=False, kind="stable").instrument.tolist()
            if ranked and not held:
                held, due = ranked[:k], cost
            elif ranked:
                worst = [s for s in held if s not in ranked] + [s for s in reversed(ranked) if s in held]
                sells = [s for s in worst if s not in ranked[:k]][:n]
                buys = [s for s in ranked if s not in held][: len(sells)]
                if sells and buys:
                    held = [s for s in held if s not in sells] + buys
                    due = cost * (len(sells) + len(buys)) / len(held)
    np.testing.assert_allclose(got.excess, want, atol=1e-12)
    taken = []

    def stream():
        for i in range(50):
            taken.append(i)
            yield pa.record_batch([pa.array(["r"] * 4), pa.array([i] * 4, pa.int32()), pa.array([None, "x", "y", "z"])], ["run", "date_idx", "instrument"])

    next(backtest.folded(stream(), 1, 1, 0.0))
    assert len(taken) == 3  # the first two dates, and the row that ends the second


def test_gates_and_zoo_round_trip(spark, tmp_path):
    z = zoo.Zoo()
    good = {"rank_ic": 0.05, "rank_ir": 0.5, "turnover": 1.0, "hac_p": 0.01}
    assert z.add(zoo.Member("a", "A", {}, {}, dict(good))) == []
    assert z.add(zoo.Member("a", "A", {}, {}, dict(good))) == ["duplicate"]
    assert z.add(zoo.Member("b", "B", {}, {}, good | {"rank_ic": None, "turnover": 1.7, "max_corr": 0.8})) == ["rank_ic", "turnover", "max_corr"]
    assert z.add(zoo.Member("c", "C", {}, {}, good | {"rank_ic": 0.02, "q_spread": 0.0})) == ["rel_rank_ic", "spread"]
    z.save(str(tmp_path / "zoo.json"))
    again = zoo.Zoo.load(str(tmp_path / "zoo.json"))
    assert again == z and len(json.loads((tmp_path / "zoo.json").read_text())["criteria"]) == 14
    assert z.relative_rank("rank_ic", 0.01) == 1.0 and z.relative_rank("rank_ic", None) == 0.0


def test_generalization_steps(spark):
    cases = [(0.1, None, 1.0), (0.1, -0.01, 0.2), (0.1, 0.02, 0.6), (0.1, 0.05, 0.85), (0.1, 0.09, 1.0), (0.0, 0.5, 1.0)]
    df = spark.createDataFrame(cases, "t double, v double, want double").withColumn("got", zoo.generalization(F.col("t"), F.col("v")))
    assert df.where("got <> want").count() == 0


def _search_panel(spark):
    from panelforge.sources import panel as P

    p = P.synthetic_panel(spark, instruments=15, days=160)
    return p.withColumns({"fwd": P.forward_return(5), "ret1": P.forward_return(1)})


def test_evaluation_trains_and_validates_on_dates_of_their_own(spark):
    from panelforge.operators import metrics
    from panelforge.operators.zoo import METRICS, Zoo
    from panelforge.plans.compiler import factor_values
    from panelforge.plans.formula import Formula, FormulaError
    from panelforge.plans.templates import formula_of
    from panelforge.search.tree import Candidate, Split, evaluate

    panel, split = _search_panel(spark), Split.at(160, 0.6)
    assert split == Split((0, 95), (96, 159))
    flat = Formula.parse({"formula": [{"name": "Greater", "input": ["high", "low"], "output": "out"}], "arguments": [{}]})
    got = evaluate(panel, [formula_of("pressure"), flat], Zoo(), 5, split)
    assert isinstance(got[1], FormulaError) and "same value" in str(got[1])
    one = got[0]
    assert isinstance(one, Candidate) and set(METRICS) - {"recon_r2"} <= one.metrics.keys() and 0 <= one.overall <= 1
    daily = metrics.daily_rank_ic(factor_values(panel, {"x": one.formula.tree(one.arguments)}, ("fwd",))).toPandas()
    for name, (a, b) in (("rank_ic", split.train), ("rank_ic_valid", split.valid)):
        part = daily[daily.date_idx.between(a, b)].ic
        assert abs(one.metrics[name] - part.mean()) < 1e-9
    again = evaluate(panel, [formula_of("pressure")], Zoo(members=[_member(one)]), 5, split)[0]
    assert again.metrics["max_corr"] > 0.999 and again.scores["diversity"] == 0.0


def _member(c):
    from panelforge.operators.zoo import Member

    return Member(c.formula.name, c.expression, c.formula.to_json(), c.arguments, c.metrics | {"max_corr": 0.0})


def test_a_short_search_admits_what_passes_open_gates(spark):
    from panelforge.operators.zoo import Criteria, Zoo
    from panelforge.search.proposer import TemplateProposer, overfit_score
    from panelforge.plans.templates import formula_of
    from panelforge.search.tree import mine

    found = Zoo(Criteria(-1.0, -10.0, 2.1, max_hac_pvalue=1.0, max_control_ic=1.0, min_block_frac=0.0, min_year_frac=0.0, min_q_spread=-1e9, min_ls_sharpe=-1e9))
    count = mine(spark, _search_panel(spark), TemplateProposer(), found, 5, trees=1, budget=1, most_budget=1)
    assert count.trees == 1 and count.generated >= 2 and count.added == len(found.members) >= 1
    assert all(m.metrics["rank_ic_valid"] is not None and m.overfit_reason for m in found.members)
    plain = formula_of("reversal", a=20).tree({"a": 20})
    assert overfit_score(plain)[0] == 10.0 and overfit_score(plain, 4)[0] == 9.0
    assert abs(overfit_score(formula_of("reversal").tree({"a": 47}))[0] - 9.4) < 1e-12


def test_automatic_lag_matches_a_loop(spark):
    import math

    import numpy as np

    from panelforge.operators import robustness

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for name, n in (("a", 700), ("b", 90), ("c", 4), ("d", 2)):
        x = np.cumsum(rng.normal(0.01, 0.1, n)) * 0.1 + rng.normal(0.02, 1, n)
        rows += [(name, i, float(v)) for i, v in enumerate(x)]
        if n < 3:
            want[name] = (None, 1.0)
            continue
        lag, d = min(int(4 * (n / 100) ** (2 / 9)), n - 1), x - x.mean()
        var = (d @ d + 2 * sum((1 - k / (lag + 1)) * (d[k:] @ d[:-k]) for k in range(1, lag + 1))) / n
        t = x.mean() / math.sqrt(max(var, 1e-18) / n)
        want[name] = (t, 0.5 * math.erfc(t / math.sqrt(2)))
    df = spark.createDataFrame(rows, "factor_id string, date_idx int, ic double")
    for r in robustness.newey_west(df).collect():
        t, p = want[r.factor_id]
        assert (r.t is None) == (t is None) and (t is None or abs(r.t - t) < 1e-9) and abs(r.p - p) < 1e-9


def test_learnt_combinations_follow_a_signal_and_drop_n_matches_a_loop(spark):
    import numpy as np
    import pandas as pd

    from panelforge.operators import backtest, combine

    rng = np.random.default_rng(8)
    days, names = 40, 12
    x = rng.normal(size=(2, days, names))
    fwd = x[0] - 0.5 * x[1] + 0.2 * rng.normal(size=(days, names))
    date = pd.date_range("2020-01-01", periods=days).date
    cells = [(f, date[d], d, str(i), i, float(x[k, d, i]), float(fwd[d, i])) for k, f in enumerate("ab") for d in range(days) for i in range(names)]
    feats = spark.createDataFrame(cells, "factor_id string, date date, date_idx int, instrument string, inst_ord int, value double, fwd double")
    normal = combine.rank_normalized(feats)
    for made in (combine.gbt(normal, ["a", "b"], 25), combine.mlp(normal, ["a", "b"], 25, batch=32)):
        got = made.where("date_idx > 25").toPandas()
        got["fwd"] = [fwd[d, int(i)] for d, i in zip(got.date_idx, got.instrument)]
        assert got.groupby("date_idx").apply(lambda g: g.pred.rank().corr(g.fwd.rank()), include_groups=False).mean() > 0.6
    pred, ret = x[0], rng.normal(0, 0.02, (days, names))
    p = spark.createDataFrame([(date[d], d, str(i), i, float(pred[d, i])) for d in range(days) for i in range(names)], "date date, date_idx int, instrument string, inst_ord int, pred double")
    r = spark.createDataFrame([(date[d], d, str(i), float(ret[d, i]), float(ret[d, i])) for d in range(days) for i in range(names)], "date date, date_idx int, instrument string, ret double, bench double")
    got = {q.date_idx: q.excess for q in backtest.top_k_drop_n(p, r, 2, share=0.34, cost=0.001).collect()}
    k, held, due = max(1, round(0.34 * names)), [], 0.0
    n = max(1, round(k / 2))
    for d in range(days):
        if d:
            port = np.mean([ret[d, i] for i in held]) if held else 0.0
            assert abs(got[d] - (port - ret[d].mean() - due)) < 1e-12
        due, order = 0.0, sorted(range(names), key=lambda i: -pred[d, i])
        if not held:
            held, due = order[:k], 0.001
            continue
        out = sorted((i for i in held if i not in order[:k]), key=order.index, reverse=True)[:n]
        into = [i for i in order if i not in held][: len(out)]
        if out:
            held = [i for i in held if i not in out] + into
            due = 0.001 * 2 * len(out) / len(held)


def test_values_are_neutralised_and_then_masked(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from panelforge.plans.templates import formula_of
    from panelforge.search.tree import prepared

    panel = _search_panel(spark).where("date_idx < 30")
    panel = panel.withColumns({"industry": F.when(F.col("inst_ord") % 2 == 0, "a").otherwise("b"), "in_universe": F.col("inst_ord") < 8})
    tree = {"x": formula_of("reversal").tree({"a": 2})}
    raw, got = prepared(panel.drop("industry", "in_universe"), tree).toPandas(), prepared(panel, tree).toPandas()
    raw["group"] = raw.inst_ord % 2
    raw["want"] = raw.value - raw.groupby(["date_idx", "group"]).value.transform("mean")
    both = raw.merge(got, on=["date_idx", "inst_ord"], suffixes=("", "_got"))
    member = both.inst_ord < 8
    assert both.loc[~member, ["value_got", "fwd_got", "ret1_got"]].isna().all().all()
    assert np.allclose(both.want[member].fillna(9), both.value_got[member].fillna(9)) and (both.fwd[member].fillna(9) == both.fwd_got[member].fillna(9)).all()


def test_period_reports(spark):
    import numpy as np

    from panelforge.operators import reports

    ic = [0.1, 0.2, 0.3, -0.1, None, -0.3]
    daily = spark.createDataFrame([("x", d, v) for d, v in enumerate(ic)], "factor_id string, date_idx int, ic double")
    r = reports.period_report(daily, 2).first()
    assert np.allclose([r.rank_ic_train, r.rank_ir_train, r.rank_ic_valid], [0.2, 2.0, -0.2]) and r.sign_flip and r.generalization == 0.2
    assert reports.still_valid(daily, 2).count() == 0 and [q.factor_id for q in reports.still_valid(daily, -1).collect()] == ["x"]
    w = spark.createDataFrame([("x", 0, 9.0), ("x", 3, 0.5), ("x", 4, 0.0)], "factor_id string, date_idx int, weight double")
    assert reports.weight_summary(w, 2).first() == ("x", 0.25, 0.5)
    got = reports.cumulative(spark.createDataFrame([("x", 0, 0.1), ("x", 1, -0.5)], "factor_id string, date_idx int, ret double")).orderBy("date_idx").collect()
    assert np.allclose([q.total for q in got], [0.1, -0.45])


def test_growth_keeps_its_digits_where_nearly_all_is_lost(spark):
    from panelforge.operators import reports

    rows = [("x", i, -0.999) for i in range(8)]
    got = reports.cumulative(spark.createDataFrame(rows, "factor_id string, date_idx int, ret double")).orderBy("date_idx").collect()
    assert [r.growth for r in got] == pytest.approx([0.001 ** (i + 1) for i in range(8)], rel=1e-9)


def test_dealt_values_are_ranked_without_an_exchange_and_with_one_sort(spark, values):
    ranked = metrics.dealt(values.select("factor_id", "date", "value")).withColumn("rank", metrics.cs_rank("value"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
    assert ranked.rdd.getNumPartitions() == metrics.PARTS
