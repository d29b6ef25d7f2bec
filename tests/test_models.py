"""Learnt combinations against local loops; tear sheets by value quantiles against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting, network, reports


def rows_of(spark, x, y, per_date=20):
    rows = [(i // per_date, i % per_date, *map(float, x[i]), float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "date_idx int, inst_ord int, " + ", ".join(f"x{j} double" for j in range(x.shape[1])) + ", y double")


# ---------------------------------------------------------------- network


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    net = network.Network((3, 5, 4, 1))
    x, y = rng.normal(size=(30, 3)), rng.normal(size=30)
    loss = lambda w: ((network.Network(net.sizes, w).predict(x) - y) ** 2).mean()
    got = net.gradient(net.w, x, y)
    step = np.eye(len(net.w)) * 1e-6
    np.testing.assert_allclose(got, [(loss(net.w + s) - loss(net.w - s)) / 2e-6 for s in step], atol=1e-7)


def test_dropout_leaves_the_mean():
    net, rng = network.Network((4, 2000, 1)), np.random.default_rng(2)
    x, y = np.ones((1, 4)), np.zeros(1)
    last = slice(4 * 2000 + 2000, -1)  # of the last layer's weights
    whole = net.gradient(net.w, x, y)[last]
    some = np.mean([net.gradient(net.w, x, y + net.predict(x) * 0, 0.3, rng)[-1] for _ in range(200)])
    assert some == pytest.approx(net.gradient(net.w, x, y)[-1], abs=0.1) and (net.gradient(net.w, x, y, 0.3, rng)[last] == 0).mean() > (whole == 0).mean() + 0.1


@pytest.mark.parametrize(("n", "late"), [(95, 9), (5, 1), (40, 4), (41, 4)])
def test_the_last_tenth_is_held_out(spark, n, late):
    out = network.held_out(rows_of(spark, np.zeros((n, 1)), np.zeros(n), 7)).toPandas().sort_values(["date_idx", "inst_ord"])
    assert out.late.tolist() == [False] * (n - late) + [True] * late


def test_passes_of_one_worker_equal_a_local_loop(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 2)), rng.normal(size=200)
    got, losses = network.fit(rows_of(spark, x, y), ["x0", "x1"], hidden=(6,), rate=0.05, dropout=0.0, batch=1000, passes=7, patience=99)
    w = network.Network((2, 6, 1)).w
    m, v, best, want = 0.0, 0.0, np.inf, []
    for t in range(1, 8):
        g = network.Network((2, 6, 1)).gradient(w, x[:180], y[:180])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        want.append(((network.Network((2, 6, 1), w).predict(x[180:]) - y[180:]) ** 2).mean())
        if want[-1] < best - 1e-6:
            best, kept = want[-1], w
    np.testing.assert_allclose(losses, want, atol=1e-9)
    np.testing.assert_allclose(got.w, kept, atol=1e-9)


def test_early_stopping_keeps_the_best_pass_and_noise_does_not_help(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-0.5, 0.5, (1200, 4))
    signal = x[:, 0] - x[:, 1] * (x[:, 0] > 0)
    ic = {}
    for name, y in (("signal", signal + 0.1 * rng.normal(size=1200)), ("noise", rng.normal(size=1200) * 0.3)):
        train = rows_of(spark, x[:900], y[:900])
        net, losses = network.fit(train, [f"x{j}" for j in range(4)], hidden=(32, 16), rate=0.01, batch=64, passes=25, patience=3, workers=2)
        own = ((net.predict(x[810:900]) - y[810:900]) ** 2).mean()
        better = [loss for i, loss in enumerate(losses) if loss < min(losses[:i], default=np.inf) - network.BETTER]
        assert own == pytest.approx(better[-1]) and len(losses) <= 25
        if name == "noise":
            assert len(losses) < 25  # it was stopped
        ic[name] = pd.Series(net.predict(x[900:])).rank().corr(pd.Series(y[900:]).rank())
    assert ic["signal"] > 0.8 and abs(ic["noise"]) < 0.2


# ---------------------------------------------------------------- boosted trees


def local_boosting(x, y, trees, g: boosting.Growth, cuts):
    """Leaf by leaf, with all rows at hand: of the leaves there are, the one whose split gains most is split next."""
    b = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    pred, shrink = np.full(len(y), y.mean()), lambda s: np.sign(s) * max(abs(s) - g.l1, 0)
    for _ in range(trees):
        grad = pred - y

        def split(rows, depth):
            best = None
            if depth >= g.depth:
                return None
            score = lambda r: shrink(grad[r].sum()) ** 2 / (len(r) + g.l2)
            for j in range(x.shape[1]):
                for cut in range(g.bins):
                    left, right = rows[b[rows, j] <= cut], rows[b[rows, j] > cut]
                    if min(len(left), len(right)) >= g.least:
                        gain = score(left) + score(right) - score(rows)
                        if gain > 1e-10 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, left, right)
            return best

        leaves = [(np.arange(len(y)), 0, split(np.arange(len(y)), 0))]
        while len(leaves) < g.leaves and any(s for _, _, s in leaves):
            i = max((i for i, leaf in enumerate(leaves) if leaf[2]), key=lambda i: leaves[i][2][0])
            _, depth, (_, left, right) = leaves.pop(i)
            leaves += [(r, depth + 1, split(r, depth + 1)) for r in (left, right)]
        for rows, _, _ in leaves:
            pred[rows] -= g.rate * shrink(grad[rows].sum()) / (len(rows) + g.l2)
    return pred


def test_boosting_equals_a_local_loop_on_a_thousand_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.uniform(-0.5, 0.5, (1000, 3)).round(2)
    y = np.sin(6 * x[:, 0]) * (x[:, 1] > 0) + 0.3 * x[:, 2] + 0.2 * rng.normal(size=1000)
    growth = boosting.Growth(leaves=7, depth=4, bins=15, rate=0.3)
    monkeypatch.setattr(boosting, "STORED_EVERY", 2)
    model = boosting.fit(rows_of(spark, x, y).repartition(3), ["x0", "x1", "x2"], 3, growth, error=0.0)
    np.testing.assert_allclose(model.predict(x), local_boosting(x, y, 3, growth, model.cuts), atol=1e-9)
    assert all((t.feature >= 0).sum() == 6 for t in model.trees)


def test_growth_is_best_first_and_bounded():
    """One side has all the signal: with 8 leaves the tree goes down there, to its depth."""
    rng = np.random.default_rng(6)
    b = rng.integers(0, 64, (4000, 1))
    left = np.where(b[:, 0] < 32, b[:, 0] % 7, 0.0)
    growth = boosting.Growth(leaves=8, depth=5, bins=63, l1=0.0)

    def sums(tree, nodes):
        at, out = tree.nodes(b), np.zeros((2, len(nodes), 1, 64))
        for i, node in enumerate(nodes):
            rows = at == node
            out[0, i, 0], out[1, i, 0] = np.bincount(b[rows, 0], -left[rows], 64), np.bincount(b[rows, 0], minlength=64)
        return out

    tree = boosting.grown(sums, growth, 1)
    assert (tree.feature >= 0).sum() == 7 and np.flatnonzero(tree.feature >= 0).max() < 1 << 5
    assert len(set(tree.nodes(b)[b[:, 0] > 32])) == 1


def test_constant_features_and_few_rows(spark):
    x, y = np.zeros((50, 2)), np.arange(50.0)
    model = boosting.fit(rows_of(spark, x, y), ["x0", "x1"], 3)
    assert model.predict(np.zeros((2, 2))).tolist() == [24.5, 24.5] and not model.trees
    few = boosting.fit(rows_of(spark, np.arange(60.0).reshape(30, 2), np.arange(30.0)), ["x0", "x1"], 3)
    assert not few.trees  # no leaf may have fewer than 20 rows


# ---------------------------------------------------------------- tear sheets by value quantiles


@pytest.fixture(scope="module")
def sheet(spark):
    rng = np.random.default_rng(7)
    days, names = 90, 17
    v = rng.normal(size=(days, names)).round(1)  # ties
    v[3] = 1.0  # one value
    v[4] = rng.integers(0, 3, names)  # three values
    v[5, 3:] = np.nan  # three rows
    ret, fwd = 0.02 * v + rng.normal(0, 0.03, (days, names)), 0.05 * v + rng.normal(0, 0.06, (days, names))
    ret[6, 2] = fwd[7, 5] = np.nan
    known = lambda q: None if np.isnan(q) else float(q)
    rows = [("f", i, str(j), j, known(v[i, j]), known(fwd[i, j]), known(ret[i, j])) for i in range(days) for j in range(names)]
    df = spark.createDataFrame(rows, "factor_id string, date_idx int, instrument string, inst_ord int, value double, fwd double, ret1 double")
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("date_idx"))).cache()


def quantiles(sheet):
    p = sheet.toPandas().dropna(subset=["value", "fwd", "ret1"])

    def cut(x):
        try:
            return pd.qcut(x, 5, labels=False) + 1
        except ValueError:
            return pd.Series(np.nan, x.index)

    p["bucket"] = p.groupby("date_idx").value.transform(cut)
    return p.dropna(subset=["bucket"])


def test_buckets_are_those_of_interpolated_quantiles(sheet):
    want = quantiles(sheet)
    got = reports.value_buckets(sheet).toPandas()
    key = ["date_idx", "inst_ord"]
    assert not {3, 4} & set(got.date_idx) and len(want) > 1300
    pd.testing.assert_series_equal(got.set_index(key).bucket.sort_index(), want.set_index(key).bucket.astype("int32").sort_index())


def test_value_tear_sheet_and_csv(spark, sheet, tmp_path):
    periods = {"IS": (0, 59), "OOS": (60, 89)}
    row = reports.value_tear_sheet(sheet, 4, periods).first()
    p = quantiles(sheet)
    for name, (a, b) in periods.items():
        part = p[p.date_idx.between(a, b)].copy()
        ic = part.groupby("date_idx").apply(lambda g: g.value.rank().corr(g.fwd.rank()), include_groups=False).dropna()
        part["r"] = part.ret1 - part.groupby("date_idx").ret1.transform("mean")
        by = part.groupby(["date_idx", "bucket"]).r.mean().unstack()
        ls = (by[5] - by[1]).dropna()
        gap = ic.iloc[::4]
        want = (ic.mean(), ic.mean() / ic.std(), gap.mean() / gap.std(), ls.mean() / ls.std() * 252**0.5)
        assert tuple(row[f"{name}_{c}"] for c in ("ic", "icir", "icir_gap", "ls_sharpe")) == pytest.approx(want)
    reports.write_tear_sheets(sheet, 4, periods, str(tmp_path / "sheets"))
    summary = spark.read.option("header", True).csv(str(tmp_path / "sheets/summary"))
    assert summary.count() == 1 and float(summary.first().OOS_ic) == pytest.approx(row.OOS_ic)
    spread = spark.read.option("header", True).csv(str(tmp_path / "sheets/OOS/spread")).toPandas().sort_values("date")
    np.testing.assert_allclose(spread.total.astype(float), (1 + ls).cumprod() - 1, atol=1e-12)
    assert spark.read.option("header", True).csv(str(tmp_path / "sheets/IS/quantiles")).select("bucket").distinct().count() == 5


def test_rolling_ic_is_pandas_rolling(spark, sheet):
    from panelforge.operators import metrics

    daily = metrics.daily_rank_ic(sheet)
    got = reports.rolling_ic(daily).toPandas().sort_values("date")
    ic = daily.toPandas().sort_values("date_idx").ic.dropna()
    np.testing.assert_allclose(got["rolling"].astype(float), ic.rolling(60, min_periods=20).mean(), atol=1e-12)
    np.testing.assert_allclose(got.total, ic.cumsum(), atol=1e-12)
