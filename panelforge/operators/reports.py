"""Reports on factors by period. Inputs are long, as in operators.metrics, with ret1, the next period's return, where said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.windows import series
from panelforge.operators import longshort, metrics
from panelforge.operators.zoo import generalization


def _ratio(x: Column) -> Column:
    """Mean over standard deviation, null without deviation."""
    return F.when(F.stddev_samp(x) > 1e-12, F.avg(x) / F.stddev_samp(x))


def period_report(daily_ic: DataFrame, last_train: int) -> DataFrame:
    """factor_id, rank IC and rank IR of the training dates and of those after, whether the sign flips, and what that
    leaves of an overfitting score. One aggregation over the daily series."""
    out = daily_ic.groupBy("factor_id").agg(
        *(
            f.alias(f"{name}_{period}")
            for period, on in (("train", F.col("date_idx") <= last_train), ("valid", F.col("date_idx") > last_train))
            for x in (F.when(on, F.col("ic")),)
            for name, f in (("rank_ic", F.avg(x)), ("rank_ir", _ratio(x)))
        )
    )
    return out.withColumns({
        "sign_flip": F.coalesce(F.col("rank_ic_train") * F.col("rank_ic_valid") < 0, F.lit(False)),
        "generalization": generalization(F.col("rank_ic_train"), F.col("rank_ic_valid")),
    })


def by_period(values: DataFrame, last_train: int) -> DataFrame:
    """``values`` with the period as part of the factor's name, so that all daily statistics are those of a period."""
    return values.withColumn("factor_id", F.concat_ws("|", "factor_id", F.when(F.col("date_idx") <= last_train, "train").otherwise("valid")))


def longshort_report(values: DataFrame, last_train: int, least_monotonic: float = 0.75, least_sharpe: float = 1.0) -> DataFrame:
    """factor_id, period, spread, monotonic, sharpe (of next-period returns), rank_ic, passes."""
    v = by_period(values, last_train)
    means = longshort.quantile_means(v)
    out = (
        longshort.quantile_spread(means).join(longshort.monotonic_fraction(means), "factor_id", "left")
        .join(longshort.annual_sharpe(longshort.long_short_returns(v.withColumn("fwd", F.col("ret1")))), "factor_id", "left")
        .join(metrics.mean_and_ir(metrics.daily_rank_ic(v), mean="rank_ic").drop("ir"), "factor_id", "left")
    )
    passes = (F.col("spread") > 0) & (F.col("monotonic") >= least_monotonic) & (F.col("sharpe") >= least_sharpe)
    part = lambda i: F.split_part("factor_id", F.lit("|"), F.lit(i))
    return out.select(part(1).alias("factor_id"), part(2).alias("period"), "spread", "monotonic", "sharpe", "rank_ic", F.coalesce(passes, F.lit(False)).alias("passes"))


def demeaned_returns(values: DataFrame, n: int = 5) -> DataFrame:
    """factor_id, date, date_idx, bucket, r: mean next-period return of each bucket less that of all its date's ranked instruments."""
    known = longshort.quantile_labels(values, n).where("bucket is not null and ret1 is not null")
    mean = F.avg("ret1").over(Window.partitionBy("factor_id", "date"))
    return known.withColumn("r", F.col("ret1") - mean).groupBy("factor_id", "date", "date_idx", "bucket").agg(F.avg("r").alias("r"))


def spread_returns(demeaned: DataFrame, n: int = 5) -> DataFrame:
    """factor_id, date, date_idx, ret: top less bottom bucket, where both are there."""
    side = lambda b: F.max(F.when(F.col("bucket") == b, F.col("r")))
    return demeaned.groupBy("factor_id", "date", "date_idx").agg((side(n) - side(1)).alias("ret")).where("ret is not null")


def tear_sheet(values: DataFrame, horizon: int) -> DataFrame:
    """factor_id, mean_ic, icir, icir_gap (of every ``horizon``-th observation, whose returns don't overlap), ls_sharpe, ls_total."""
    ic = metrics.daily_rank_ic(values).where("ic is not null").withColumn("place", F.row_number().over(series()) - 1)
    gap = F.when(F.col("place") % horizon == 0, F.col("ic"))
    ics = ic.groupBy("factor_id").agg(F.avg("ic").alias("mean_ic"), _ratio(F.col("ic")).alias("icir"), _ratio(gap).alias("icir_gap"))
    spread = spread_returns(demeaned_returns(values)).groupBy("factor_id").agg(
        (_ratio(F.col("ret")) * F.sqrt(F.lit(float(longshort.TRADING_DAYS)))).alias("ls_sharpe"), (F.product(1 + F.col("ret")) - 1).alias("ls_total")
    )
    return ics.join(spread, "factor_id", "left")


def cumulative(returns: DataFrame, keys: tuple[str, ...] = ("factor_id",), column: str = "ret") -> DataFrame:
    """``returns`` with growth, what one unit has grown to by each date, and total, what it has grown by.

    A unit that is nearly lost has its digits in growth only: total is then -1 and a rounding error.
    """
    upto = Window.partitionBy(*keys).orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("growth", F.product(1 + F.col(column)).over(upto)).withColumn("total", F.col("growth") - 1)


def weight_summary(weights: DataFrame, last_train: int) -> DataFrame:
    """factor_id, mean_weight, paused (share of dates without weight) of the dates after training."""
    after = weights.where(F.col("date_idx") > last_train)
    return after.groupBy("factor_id").agg(F.avg("weight").alias("mean_weight"), F.avg((F.col("weight") <= 1e-12).cast("double")).alias("paused"))


def still_valid(daily_ic: DataFrame, last_train: int) -> DataFrame:
    """factor_id of those whose mean rank IC after training is positive."""
    after = daily_ic.where(F.col("date_idx") > last_train).groupBy("factor_id").agg(F.avg("ic").alias("m"))
    return after.where("m > 0").select("factor_id")


def value_buckets(values: DataFrame, n: int = 5) -> DataFrame:
    """Rows of ``values`` whose value, fwd and ret1 are known, with bucket 1 to n by the value's place among the date's quantiles.

    Edges are interpolated linearly between sorted values, and a value on an edge belongs below it, so equal values share a bucket,
    which need not be as large as others. Dates whose edges aren't all different (few values, or few different ones) are left out.
    """
    known = values.where("value is not null and fwd is not null and ret1 is not null")
    days = known.groupBy("factor_id", "date").agg(F.array_sort(F.collect_list("value")).alias("v"))  # a date's instruments
    edge = f"transform(sequence(0, {n}), k -> cast(k as bigint) * (size(v) - 1))"
    low, high = f"v[cast(p div {n} as int)]", f"v[cast(least(p div {n} + 1, size(v) - 1) as int)]"
    days = days.select("factor_id", "date", F.expr(f"transform({edge}, p -> {low} + ({high} - {low}) * (p % {n}) / {float(n)}D)").alias("e"))
    days = days.where(F.expr(f"forall(sequence(0, {n - 1}), i -> e[i] < e[i + 1])")).select("factor_id", "date", F.slice("e", 2, n - 1).alias("inner"))
    bucket = 1 + F.size(F.filter("inner", lambda e: e < F.col("value")))
    return known.join(days, ["factor_id", "date"]).withColumn("bucket", bucket.cast("int")).drop("inner")


def demeaned_by_value(bucketed: DataFrame) -> DataFrame:
    """factor_id, date, date_idx, bucket, r: as ``demeaned_returns``, of ``value_buckets``."""
    mean = F.avg("ret1").over(Window.partitionBy("factor_id", "date"))
    return bucketed.withColumn("r", F.col("ret1") - mean).groupBy("factor_id", "date", "date_idx", "bucket").agg(F.avg("r").alias("r"))


def value_tear_sheet(values: DataFrame, horizon: int, periods: dict[str, tuple[int, int]]) -> DataFrame:
    """factor_id and, of each period (name: first and last date_idx), <name>_ic, _icir, _icir_gap (of every ``horizon``-th
    observation) and _ls_sharpe (top less bottom bucket of the next period's demeaned returns)."""
    inside = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for name, (a, b) in periods.items()))
    of = F.explode(F.filter(inside, lambda p: F.col("date_idx").between(p["a"], p["b"])))
    parts = value_buckets(values).withColumn("p", of).withColumn("factor_id", F.concat_ws("|", "factor_id", "p.name")).drop("p")
    ic = metrics.daily_rank_ic(parts).where("ic is not null").withColumn("place", F.row_number().over(series()) - 1)
    gap = F.when(F.col("place") % horizon == 0, F.col("ic"))
    ics = ic.groupBy("factor_id").agg(F.avg("ic").alias("ic"), _ratio(F.col("ic")).alias("icir"), _ratio(gap).alias("icir_gap"))
    spread = spread_returns(demeaned_by_value(parts)).groupBy("factor_id").agg((_ratio(F.col("ret")) * F.sqrt(F.lit(float(longshort.TRADING_DAYS)))).alias("ls_sharpe"))
    rows = ics.join(spread, "factor_id", "left")
    name, period = (F.split_part("factor_id", F.lit("|"), F.lit(i)) for i in (1, 2))
    pick = [F.max(F.when(period == p, F.col(c))).alias(f"{p}_{c}") for p in periods for c in ("ic", "icir", "icir_gap", "ls_sharpe")]
    return rows.groupBy(name.alias("factor_id")).agg(*pick)


def rolling_ic(daily_ic: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """factor_id, date, ic, rolling (mean of the last ``window`` observations, ``least`` at least), total (their sum so far)."""
    known = daily_ic.where("ic is not null")
    last, upto = series().rowsBetween(1 - window, 0), series().rowsBetween(Window.unboundedPreceding, 0)
    mean = F.when(F.count("ic").over(last) >= least, F.avg("ic").over(last))
    return known.select("factor_id", "date", "ic", mean.alias("rolling"), F.sum("ic").over(upto).alias("total"))


def write_tear_sheets(values: DataFrame, horizon: int, periods: dict[str, tuple[int, int]], folder: str) -> None:
    """CSV tables with headers under ``folder``: summary (a row for each factor, in one file), and for each period of all factors
    quantiles (growth of each bucket by date), spread (growth of top less bottom) and ic (rolling and total)."""
    value_tear_sheet(values, horizon, periods).orderBy("factor_id").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")
    for name, (a, b) in periods.items():
        part = value_buckets(values.where(F.col("date_idx").between(a, b)))
        returns = demeaned_by_value(part)
        tables = {
            "quantiles": cumulative(returns, ("factor_id", "bucket"), "r").select("factor_id", "bucket", "date", "total"),
            "spread": cumulative(spread_returns(returns)).select("factor_id", "date", "total"),
            "ic": rolling_ic(metrics.daily_rank_ic(part)),
        }
        for table, df in tables.items():
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}/{table}")
