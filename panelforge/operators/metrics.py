"""Cross-sectional metrics. Inputs are long: factor_id, date, date_idx, instrument, inst_ord, value, fwd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.windows import day


def cs_rank(column: str, keys: tuple[str, ...] = ("factor_id", "date")) -> Column:
    """Percentile rank within the day, ties sharing their mean rank; null stays null and doesn't count.

    Ties follow from a running count up to and with them, so that all of it takes one sort.
    """
    x, window = F.col(column), Window.partitionBy(*keys)
    ordered = window.orderBy(x.asc_nulls_last())
    rank = F.rank().over(ordered)
    ties = F.count("*").over(ordered) - rank + 1
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(window))


#: Parts that values are dealt in by factor and date.
PARTS = 120


def dealt(values: DataFrame, *keys: str) -> DataFrame:
    """``values`` dealt by factor and date. Kept so by ``persist``, every window over a date's instruments goes without an exchange; and as the
    number of parts is fixed, and not left to the plan, which puts small ones together, a task holds but a few dates of a factor.

    ``keys``: other columns to deal by; by date alone, what puts the factors of a cell together goes without an exchange, too."""
    return values.repartition(PARTS, *(keys or ("factor_id", "date")))


def daily_pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """factor_id, date, date_idx, ic: each day's correlation over complete pairs; null under three or if constant."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    mid = ok.select("factor_id", "date", "date_idx", (F.col(x) - F.avg(x).over(day())).alias("x"), (F.col(y) - F.avg(y).over(day())).alias("y"))
    xy, xx, yy = F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")), F.sum(F.col("y") * F.col("y"))
    return mid.groupBy("factor_id", "date", "date_idx").agg(F.when(F.count("*") >= 3, F.try_divide(xy, F.sqrt(xx * yy))).alias("ic"))


def daily_ic(values: DataFrame) -> DataFrame:
    return daily_pearson(values, "value", "fwd")


def daily_rank_ic(values: DataFrame) -> DataFrame:
    """Each side is ranked among its own values before pairs are matched."""
    ranked = values.withColumn("rank_value", cs_rank("value")).withColumn("rank_fwd", cs_rank("fwd"))
    return daily_pearson(ranked, "rank_value", "rank_fwd")


def mean_and_ir(series: DataFrame, column: str = "ic", mean: str = "mean", ir: str = "ir") -> DataFrame:
    """Mean of each factor's series, and mean over standard deviation (null if that is nil)."""
    sd = F.stddev_samp(column)
    return series.groupBy("factor_id").agg(F.avg(column).alias(mean), F.when(sd > 1e-12, F.avg(column) / sd).alias(ir))


def coverage(values: DataFrame) -> DataFrame:
    return values.groupBy("factor_id").agg((F.count("value") / F.count("*")).alias("coverage"))


def top_weights(values: DataFrame, share: float = 0.1) -> DataFrame:
    """``values`` with weight: equal over the day's top share (at least one), 0 elsewhere; ties by instrument."""
    n = F.count("value").over(day())
    k = F.rint(F.greatest(n * share, F.lit(1.0)))
    place = F.row_number().over(day().orderBy(F.col("value").desc_nulls_last(), "inst_ord"))
    return values.withColumn("weight", F.when(F.col("value").isNotNull() & (place <= k), 1 / k).otherwise(F.lit(0.0)))


def daily_turnover(values: DataFrame, share: float = 0.1) -> DataFrame:
    """factor_id, turnover: mean over active days but the first of the sum of weight changes since the last active day."""
    weighted = top_weights(values, share)
    active = weighted.withColumn("active", F.sum("weight").over(day()) > 0).where("active")
    own = Window.partitionBy("factor_id", "instrument").orderBy("date_idx")
    moved = active.withColumn("moved", F.abs(F.col("weight") - F.lag("weight").over(own)))
    daily = moved.groupBy("factor_id", "date").agg(F.sum("moved").alias("turnover"))
    return daily.groupBy("factor_id").agg(F.avg("turnover").alias("turnover"))


def factor_correlation(values: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """factor_id, other_id, corr: mean daily rank correlation of each pair (all pairs a < b, or those given)."""
    ranked = values.select("factor_id", "date", "date_idx", "instrument", cs_rank("value").alias("rank")).where("rank is not null")
    a = ranked.select(F.col("factor_id").alias("a"), "date", "date_idx", "instrument", F.col("rank").alias("x"))
    b = ranked.select(F.col("factor_id").alias("b"), "date", "instrument", F.col("rank").alias("y"))
    both = a.join(b, ["date", "instrument"]) if pairs is None else a.join(F.broadcast(pairs), "a").join(b, ["b", "date", "instrument"])
    both = both.where("a < b") if pairs is None else both
    day = both.select(F.concat_ws("\u0001", "a", "b").alias("factor_id"), "date", "date_idx", "x", "y")
    mean = daily_pearson(day, "x", "y").groupBy("factor_id").agg(F.avg("ic").alias("corr"))
    return mean.select(
        F.split_part("factor_id", F.lit("\u0001"), F.lit(1)).alias("factor_id"), F.split_part("factor_id", F.lit("\u0001"), F.lit(2)).alias("other_id"), "corr"
    )


def alpha_metrics(values: DataFrame, share: float = 0.1, rank_ic: DataFrame | None = None) -> DataFrame:
    """factor_id with ic, ic_ir, rank_ic, rank_ir, turnover and coverage of every factor, in one job. ``rank_ic``: the daily series, if at hand."""
    rank_ic = daily_rank_ic(values) if rank_ic is None else rank_ic
    return (
        mean_and_ir(daily_ic(values), mean="ic", ir="ic_ir").join(mean_and_ir(rank_ic, mean="rank_ic", ir="rank_ir"), "factor_id")
        .join(daily_turnover(values, share), "factor_id", "left").join(coverage(values), "factor_id")
    )


