"""How combinations of factors do: sizes, models and periods as runs of one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import backtest, combine, metrics
from panelforge.operators.neutralize import in_universe, neutralize
from panelforge.plans.compiler import factor_values
from panelforge.plans.formula import Node

#: Decimal places of a prediction.
PLACES = 9
CELL = ("date", "date_idx", "instrument", "inst_ord")


def features(panel: DataFrame, trees: Mapping[str, Node]) -> DataFrame:
    """factor_id, keys, value, fwd: each date's ranks, around 0, of the factors' values over the whole history.

    Neutralised and then cut to the universe, as far as ``panel`` has industry, log_mv and in_universe; missing ranks are 0, and fwd is
    that of members only. Dealt by date, so that, once kept by ``persist``, neither ranks nor combinations of it need an exchange.
    """
    keep = tuple(c for c in ("fwd", "industry", "log_mv", "in_universe") if c in panel.columns)
    values = neutralize(metrics.dealt(factor_values(panel, trees, keep), "date"))
    if "in_universe" in keep:
        values = in_universe(values).withColumn("fwd", F.when(F.col("in_universe"), F.col("fwd")))
    return combine.rank_normalized(values).select("factor_id", *CELL, "value", "fwd")


def market(panel: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """date_idx, instrument, ret, bench (members' returns), open (whether there is a close and the name is a member), fwd (members').

    ``returns``: date_idx, instrument, ret; without it ``panel`` has ret.
    """
    member = F.col("in_universe") if "in_universe" in panel.columns else F.lit(True)
    own = [F.when(member, F.col("fwd")).alias("fwd"), member.alias("__m"), (member & F.col("close").isNotNull()).alias("open")]
    both = panel.select("date_idx", "instrument", *own, *(["ret"] if returns is None else []))
    if returns is not None:
        both = both.join(returns.select("date_idx", "instrument", "ret"), ["date_idx", "instrument"], "left")
    return both.withColumn("bench", F.when(F.col("__m"), F.col("ret"))).drop("__m")


def combined(features: DataFrame, factors: Sequence[str], sizes: Sequence[int], models: Sequence[str], last_train: int, horizon: int, halflife: float = 63, least: int = 60) -> DataFrame:
    """model, size, keys, pred of each model over the first ``size`` of ``factors``.

    Means and weighted means of all sizes come from one aggregation of the features, with one column a size. Predictions
    are rounded to PLACES, so that equal ones are ties in whatever order their parts were added. ``features``
    should be a stored table.
    """
    sizes = sorted({min(n, len(factors)) for n in sizes})
    place = F.element_at(F.create_map(*(x for i, f in enumerate(factors) for x in (F.lit(f), F.lit(i)))), F.col("factor_id"))
    placed = features.where(F.col("factor_id").isin(list(factors))).withColumn("place", place)
    made, parts = [], {}
    if "equal" in models:
        parts |= {("equal", n): F.avg(F.when(F.col("place") < n, F.col("value"))) for n in sizes}
    if "ewma" in models:
        past = combine.past_ic(features, halflife, least, horizon).select("factor_id", "date", "s")
        placed = placed.join(F.broadcast(past), ["factor_id", "date"])  # a row for each factor and date
        for n in sizes:
            own = F.col("place") < n
            total, count = F.sum(F.when(own, F.col("s"))), F.sum(own.cast("int"))
            weighed = F.sum(F.when(own, F.col("value") * F.col("s"))) / total + F.coalesce(F.sum(F.when(own & F.col("s").isNull(), F.col("value"))), F.lit(0.0)) / count
            parts["ewma", n] = F.when(total > 0, weighed).otherwise(F.avg(F.when(own, F.col("value"))))
    if parts:
        names = {key: f"p{i}" for i, key in enumerate(parts)}
        wide = placed.groupBy(*CELL).agg(*(parts[key].alias(name) for key, name in names.items()))
        runs = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(n).alias("size"), F.col(name).alias("pred")) for (m, n), name in names.items())))
        made.append(wide.select(*CELL, runs.alias("r")).select("r.model", "r.size", *CELL, "r.pred"))
    for model in models:
        if model not in ("equal", "ewma"):
            for n in sizes:
                pred = combine.combine(model, features, list(factors[:n]), last_train, horizon)
                made.append(pred.select(F.lit(model).alias("model"), F.lit(n).alias("size"), *CELL, "pred"))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.withColumn("pred", F.round("pred", PLACES))


def evaluate(
    pred: DataFrame, market: DataFrame, periods: Mapping[str, tuple[int, int]], horizon: int, mode: str = "topk_dropn", share: float = 0.1, cost: float = 0.0015
) -> DataFrame:
    """model, size, period, ic, rank_ic, days, aer, ir of every run and period (first and last date_idx).

    Predictions only count where the instrument can be traded and is a member. A run is a model, size and period; statistics
    and backtests of all of them are keyed by it, and a backtest begins anew with its period. ``mode``: topk_dropn or periodic.
    ``market`` should be a stored table.
    """
    named = F.filter(
        F.array(*(F.struct(F.lit(p).alias("period"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, (a, b) in periods.items())),
        lambda p: F.col("date_idx").between(p["a"], p["b"]),
    )
    runs = pred.join(market.select("date_idx", "instrument", "open", "fwd"), ["date_idx", "instrument"]).withColumn("p", F.explode(named))
    name = F.concat_ws("|", "model", "size", "p.period")
    runs = metrics.dealt(runs.select(name.alias("run_id"), *CELL, F.when(F.col("open"), F.col("pred")).alias("pred"), "fwd"), "run_id", "date").persist()
    values = runs.withColumnsRenamed({"run_id": "factor_id", "pred": "value"})
    ic = metrics.daily_ic(values).groupBy("factor_id").agg(F.avg("ic").alias("ic"))
    rank_ic = metrics.daily_rank_ic(values).groupBy("factor_id").agg(F.avg("ic").alias("rank_ic"))
    test = backtest.periodic_runs if mode == "periodic" else backtest.top_k_drop_n
    done = backtest.summary(test(runs.drop("fwd"), market, horizon, share, cost), "run_id")
    every = runs.select(F.col("run_id").alias("factor_id")).distinct()
    out = every.join(ic, "factor_id", "left").join(rank_ic, "factor_id", "left").join(done.withColumnRenamed("run_id", "factor_id"), "factor_id", "left")
    part = lambda i: F.split_part("factor_id", F.lit("|"), F.lit(i))
    return out.select(part(1).alias("model"), part(2).cast("int").alias("size"), part(3).alias("period"), "ic", "rank_ic", F.coalesce("days", F.lit(0)).alias("days"), "aer", "ir")


def weights_by_period(features: DataFrame, factors: Sequence[str], sizes: Sequence[int], periods: Mapping[str, tuple[int, int]], horizon: int, halflife: float = 63, least: int = 60) -> DataFrame:
    """size, period, factor_id, mean_weight, paused (share of dates without weight) of the smoothed weights."""
    past = combine.past_ic(features.where(F.col("factor_id").isin(list(factors))), halflife, least, horizon)
    place = F.element_at(F.create_map(*(x for i, f in enumerate(factors) for x in (F.lit(f), F.lit(i)))), F.col("factor_id"))
    of = F.explode(F.array(*map(F.lit, sorted({min(n, len(factors)) for n in sizes}))))
    sized = past.withColumn("size", of).where(place < F.col("size"))
    on_day = Window.partitionBy("size", "date")
    weight = F.coalesce(F.when(F.sum("s").over(on_day) > 0, F.col("s") / F.sum("s").over(on_day)), 1 / F.count("*").over(on_day))
    period = F.explode(F.filter(F.array(*(F.struct(F.lit(p).alias("period"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, (a, b) in periods.items())), lambda p: F.col("date_idx").between(p["a"], p["b"])))
    weighed = sized.withColumn("weight", weight).withColumn("p", period)
    return weighed.groupBy("size", F.col("p.period").alias("period"), "factor_id").agg(F.avg("weight").alias("mean_weight"), F.avg((F.col("weight") <= 1e-12).cast("double")).alias("paused"))
