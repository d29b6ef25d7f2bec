"""Long-short quantile decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.windows import day
from panelforge.operators.metrics import cs_rank

TRADING_DAYS = 252


def quantile_labels(values: DataFrame, n: int = 5) -> DataFrame:
    """``values`` with bucket 1 to n by rank (ties by instrument), null where the value is."""
    place = F.row_number().over(day().orderBy(F.col("value").asc_nulls_last(), "inst_ord"))
    share = place / F.count("value").over(day())
    bucket = F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(share * n))).cast("int")
    return values.withColumn("bucket", F.when(F.col("value").isNotNull(), bucket))


def quantile_means(values: DataFrame, n: int = 5) -> DataFrame:
    """factor_id, bucket, mean_return: mean over days of each bucket's daily mean; empty buckets are null."""
    daily = quantile_labels(values, n).where("bucket is not null").groupBy("factor_id", "date", "bucket").agg(F.avg("fwd").alias("r"))
    mean = daily.groupBy("factor_id", "bucket").agg(F.avg("r").alias("mean_return"))
    every = values.select("factor_id").distinct().select("factor_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("bucket"))
    return every.join(mean, ["factor_id", "bucket"], "left")


def monotonic_fraction(means: DataFrame) -> DataFrame:
    """factor_id, monotonic: share of adjacent buckets whose mean doesn't fall."""
    known = means.where("mean_return is not null")
    step = F.col("mean_return") - F.lag("mean_return").over(Window.partitionBy("factor_id").orderBy("bucket"))
    return known.withColumn("step", step).groupBy("factor_id").agg(F.avg((F.col("step") >= 0).cast("double")).alias("monotonic"))


def quantile_spread(means: DataFrame, n: int = 5) -> DataFrame:
    top, low = F.max(F.when(F.col("bucket") == n, F.col("mean_return"))), F.max(F.when(F.col("bucket") == 1, F.col("mean_return")))
    return means.groupBy("factor_id").agg((top - low).alias("spread"))


def long_short_returns(values: DataFrame, n: int = 5) -> DataFrame:
    """factor_id, date, date_idx, ret: mean return of the top bucket less the bottom's, days without either left out."""
    top, low = F.avg(F.when(F.col("bucket") == n, F.col("fwd"))), F.avg(F.when(F.col("bucket") == 1, F.col("fwd")))
    return quantile_labels(values, n).groupBy("factor_id", "date", "date_idx").agg((top - low).alias("ret")).where("ret is not null")


def annual_sharpe(returns: DataFrame, column: str = "ret") -> DataFrame:
    """factor_id, sharpe: annualised; null under 20 observations or without deviation."""
    sd = F.stddev_samp(column)
    return returns.groupBy("factor_id").agg(
        F.when((F.count(column) >= 20) & (sd >= 1e-12), F.avg(column) / sd * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("sharpe")
    )


def monotonicity_score(spread: Column, monotonic: Column, sharpe: Column) -> Column:
    """0 unless the spread is positive, else a mean of order and of Sharpe up to 2, missing parts counting 0."""
    part = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sharpe / 2)), F.lit(0.0))
    return F.when(spread > 0, 0.4 * F.coalesce(monotonic, F.lit(0.0)) + 0.6 * part).otherwise(F.lit(0.0))


def decile_table(values: DataFrame, n: int = 10) -> DataFrame:
    """factor_id, bucket, mean_return, cells: pooled over days, ties sharing a bucket."""
    bucket = F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(F.col("rank") * n))).cast("int")
    return (
        values.withColumn("rank", cs_rank("value")).where("rank is not null and fwd is not null").withColumn("bucket", bucket)
        .groupBy("factor_id", "bucket").agg(F.avg("fwd").alias("mean_return"), F.count("*").alias("cells"))
    )
