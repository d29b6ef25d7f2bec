"""Combining factors into one prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stored import stored
from panelforge.functions.windows import series
from panelforge.operators import boosting, network
from panelforge.operators.metrics import cs_rank, daily_rank_ic


def rank_normalized(values: DataFrame) -> DataFrame:
    """Values as day ranks from -0.5 to 0.5, missing ones 0."""
    return values.withColumn("value", F.coalesce(cs_rank("value") - 0.5, F.lit(0.0)))


def equal_weight(features: DataFrame) -> DataFrame:
    """date, date_idx, instrument, inst_ord, pred: mean of the features."""
    return features.groupBy("date", "date_idx", "instrument", "inst_ord").agg(F.avg("value").alias("pred"))


def past_ic(features: DataFrame, halflife: float, least: int, horizon: int) -> DataFrame:
    """factor_id, date, date_idx, s: each factor's smoothed past rank IC, clipped at 0; null where it has none yet.

    The exponential mean of a series with gaps is a ratio of two running sums whose weights grow towards
    the end; scaled by the last date they never exceed 1. A value is used horizon + 1 dates later.
    """
    dates = features.select("factor_id", "date", "date_idx").distinct()
    ic = dates.join(daily_rank_ic(features).select("factor_id", "date", "ic"), ["factor_id", "date"], "left")
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("date_idx").over(Window.partitionBy("factor_id"))
    grow = F.pow(F.lit(2.0), (F.col("date_idx") - last) / F.lit(float(halflife)))
    known = F.when(F.col("ic").isNotNull(), grow)
    mean = F.try_divide(F.sum(F.col("ic") * grow).over(upto), F.sum(known).over(upto))
    smooth = ic.withColumn("s", F.when(F.count("ic").over(upto) >= least, mean))
    lagged = F.lag("s", horizon + 1).over(series())
    return smooth.select("factor_id", "date", "date_idx", F.when(lagged.isNotNull(), F.greatest(lagged, F.lit(0.0))).alias("s"))


def ewma_weights(features: DataFrame, halflife: float, least: int, horizon: int) -> DataFrame:
    """factor_id, date, date_idx, weight: each factor's ``past_ic``, shared out. Where a factor has none yet, or none is
    positive, it gets an equal share."""
    on_day = Window.partitionBy("date")
    total = F.sum("s").over(on_day)
    n = F.count("*").over(on_day)
    past = past_ic(features, halflife, least, horizon)
    return past.select("factor_id", "date", "date_idx", F.coalesce(F.when(total > 0, F.col("s") / total), 1 / n).alias("weight"))


def weighted(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Prediction of the features under each date's weights."""
    w = weights.select("factor_id", "date", "weight")  # a row for each factor and date
    return features.join(F.broadcast(w), ["factor_id", "date"]).groupBy("date", "date_idx", "instrument", "inst_ord").agg(F.sum(F.col("value") * F.col("weight")).alias("pred"))


def table(features: DataFrame, factors: list[str]) -> DataFrame:
    """One row per cell with a column x0, x1, ... per factor, and fwd as a rank around 0 (null where unknown)."""
    columns = [F.coalesce(F.max(F.when(F.col("factor_id") == f, F.col("value"))), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(factors)]
    cells = features.groupBy("date", "date_idx", "instrument", "inst_ord").agg(F.first("fwd").alias("fwd"), *columns)
    return cells.withColumn("y", cs_rank("fwd", ("date",)) - 0.5)


def _cells(features: DataFrame, factors: list[str]) -> DataFrame:
    """``table``, worked out once: learners pass over it many times, so it is put together in as few parts as the plan takes to be enough."""
    return stored(table(features, factors).repartition("date", "instrument"))


def gbt(features: DataFrame, factors: list[str], last_train: int, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """Predictions of Spark's gradient-boosted trees, fitted on dates up to ``last_train``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    cells = VectorAssembler(inputCols=[f"x{i}" for i in range(len(factors))], outputCol="features").transform(_cells(features, factors))
    train = cells.where((F.col("date_idx") <= last_train) & F.col("y").isNotNull())
    model = GBTRegressor(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.05, seed=seed).fit(train)
    return model.transform(cells).select("date", "date_idx", "instrument", "inst_ord", F.col("prediction").alias("pred"))


def _learnt(features: DataFrame, factors: list[str], last_train: int, fit) -> DataFrame:
    """Predictions of what ``fit(train, columns)`` gives; training cells are those up to ``last_train`` whose return is known."""
    cells, names = _cells(features, factors), [f"x{i}" for i in range(len(factors))]
    train = cells.where((F.col("date_idx") <= last_train) & F.col("y").isNotNull()).persist()
    model = fit(train, names)
    train.unpersist()
    return cells.select("date", "date_idx", "instrument", "inst_ord", boosting.predicted(model, names).alias("pred"))


def leafwise(features: DataFrame, factors: list[str], last_train: int, trees: int = 200, growth: boosting.Growth = boosting.Growth()) -> DataFrame:
    """Predictions of boosted trees grown best leaf first."""
    return _learnt(features, factors, last_train, lambda train, names: boosting.fit(train, names, trees, growth))


def mlp(features: DataFrame, factors: list[str], last_train: int, **options) -> DataFrame:
    """Predictions of a network fitted by Adam with dropout, stopped early on the last tenth of the training cells. ``options``: of ``network.fit``."""
    return _learnt(features, factors, last_train, lambda train, names: network.fit(train, names, **options)[0])


def combine(model: str, features: DataFrame, factors: list[str], last_train: int, horizon: int, halflife: float = 63, least: int = 60) -> DataFrame:
    if model == "equal":
        return equal_weight(features)
    if model == "ewma":
        return weighted(features, ewma_weights(features, halflife, least, horizon))
    if model == "gbt":
        return gbt(features, factors, last_train)
    if model == "leafwise":
        return leafwise(features, factors, last_train)
    if model == "mlp":
        return mlp(features, factors, last_train)
    raise ValueError(f"unknown model {model!r}")
