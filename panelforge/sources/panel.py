"""The dense panel: one row per date and instrument, missing cells null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.stored import stored
from panelforge.functions.windows import clean, time

FIELDS = ("open", "high", "low", "close", "volume", "vwap")


def cents(x: Column) -> Column:
    """To four places, halves up, by the same three operations in any engine (round() differs on halves)."""
    return F.floor(x * 10000 + 0.5) / 10000


def bars(lines: DataFrame, instrument: Column, period: Column) -> DataFrame:
    """Open, high, low, close, volume and vwap of each instrument and period, from order lines.

    First and last prices are of the smallest and largest sort key, taken by aggregation; nothing is sorted.
    """
    price = cents(F.col("l_extendedprice") / F.col("l_quantity"))
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "price", "l_quantity")
    return (
        lines.withColumn("price", price).groupBy(instrument.alias("instrument"), period.alias("date"))
        .agg(
            F.min(key)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(key)["price"].alias("close"),
            F.sum("l_quantity").alias("volume"), cents(F.sum(F.col("price") * F.col("l_quantity")) / F.sum("l_quantity")).alias("vwap"),
        )
    )


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by supplier and month."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return bars(lines, F.col("l_suppkey").cast("string"), F.trunc("l_shipdate", "month"))


def brand_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by part brand and week."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return bars(lines.join(parts, lines.l_partkey == parts.p_partkey), F.col("p_brand"), F.to_date(F.date_trunc("week", "l_shipdate")))


def dense(rows: DataFrame, numeric: bool = False, unique: bool = False) -> DataFrame:
    """The grid of all dates and instruments of ``rows`` (date, instrument, fields), with their ordinals.

    ``rows`` are worked out once, whatever they come from, and their instruments, dates and cells are taken from that. A repeated
    cell is an error in the data, and raises; ``unique``: there is none, as after an aggregation. Dates are a bounded list,
    so the grid is made by giving each instrument all of them. ``numeric``: instruments are ordered as numbers.
    """
    rows = stored(rows)
    order = F.col("instrument").cast("long") if numeric else F.col("instrument")
    instruments = rows.select("instrument").distinct().withColumn("inst_ord", F.row_number().over(Window.orderBy(order)) - 1)
    calendar = rows.select("date").distinct().withColumn("date_idx", F.row_number().over(Window.orderBy("date")) - 1)
    every = calendar.agg(F.array_sort(F.collect_list(F.struct("date_idx", "date"))).alias("every"))
    grid = instruments.join(F.broadcast(every)).select("instrument", "inst_ord", F.inline("every"))
    fields = [c for c in rows.columns if c not in ("date", "instrument")]
    if unique:
        return grid.join(rows, ["date", "instrument"], "left").select("date", "date_idx", "instrument", "inst_ord", *fields)
    # one row a cell: a second one fails here rather than double a window's weights
    alone = F.when(F.count("*").over(Window.partitionBy("date", "instrument")) > 1, F.raise_error(F.lit("a date and instrument stand twice")))
    once = rows.withColumn("__twice", alone.cast("string"))
    return (
        grid.join(once, ["date", "instrument"], "left").where("__twice is null")
        .select("date", "date_idx", "instrument", "inst_ord", *fields)
    )


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(supplier_months(spark, sf_dir), numeric=True, unique=True)


def forward_return(h: int) -> Column:
    """close[t + h] / close[t] - 1 over the grid."""
    return clean(F.try_divide(F.lead("close", h).over(time()), F.col("close")) - 1)


def daily_return(pad: bool = True) -> Column:
    """Return since the row before; with ``pad``, over the last closes known at either."""
    if not pad:
        return clean(F.try_divide(F.col("close"), F.lag("close").over(time())) - 1)
    upto = time().rowsBetween(Window.unboundedPreceding, 0)
    before = time().rowsBetween(Window.unboundedPreceding, -1)
    return clean(F.try_divide(F.last("close", ignorenulls=True).over(upto), F.last("close", ignorenulls=True).over(before)) - 1)


def split_at(n_dates: int, ratio: float) -> int:
    """Ordinal of the last training date."""
    return min(max(int(n_dates * ratio) - 1, 0), n_dates - 1)


def between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the dates from ``start`` to ``end``, both included, either open."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("date") <= F.lit(end).cast("date"))


def csv_panel(spark: SparkSession, folder: str) -> DataFrame:
    """A panel from a folder of <instrument>.csv files with a date, OHLC, volume and maybe vwap.

    Headers are matched in any case and trimmed; without vwap it is the mean of the four prices.
    """
    raw = spark.read.option("header", True).csv(folder)
    names = {c.strip().lower(): c for c in raw.columns}
    if missing := [c for c in ("date", "open", "high", "low", "close", "volume") if c not in names]:
        raise ValueError(f"missing columns: {missing}")
    values = {c: F.trim(F.col(f"`{names[c]}`")).try_cast("double") for c in FIELDS if c in names}
    values.setdefault("vwap", (values["open"] + values["high"] + values["low"] + values["close"]) / 4)
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    rows = raw.select(
        F.coalesce(F.try_to_date(F.col(f"`{names['date']}`")), F.try_to_date(F.col(f"`{names['date']}`"), "yyyyMMdd")).alias("date"),
        file.alias("instrument"), *(clean(v).alias(c) for c, v in values.items()),
    )
    return dense(rows)


def jdbc_prices(spark: SparkSession, table: str, **options: str) -> DataFrame:
    """Price bars from any JDBC source; filters and column lists on the result are pushed to it.

    Address and credentials come with ``options``, never from code.
    """
    raw = spark.read.format("jdbc").options(dbtable=table, **options).load()
    mean = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    return raw.select(
        F.to_date("trade_date", "yyyyMMdd").alias("date"), F.col("ts_code").alias("instrument"),
        "open", "high", "low", "close", F.col("vol").alias("volume"), mean.alias("vwap"), "amount",
    )


def synthetic_panel(spark: SparkSession, instruments: int = 30, days: int = 300, seed: int = 7) -> DataFrame:
    """A seeded panel for trials: a common factor, slow mispricing and noise, made by Spark from row numbers."""
    start = "2015-01-04"
    dates = spark.range(days).select(F.col("id").cast("int").alias("date_idx"), F.date_add(F.lit(start).cast("date"), (F.col("id") + F.floor(F.col("id") / 5) * 2).cast("int")).alias("date"))

    def noise(*of: Column, salt: int) -> Column:  # standard normal by Box-Muller from hashes
        u = (F.pmod(F.xxhash64(*of, F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        v = F.pmod(F.xxhash64(*of, F.lit(seed), F.lit(salt + 1000)), F.lit(1 << 30)) / float(1 << 30)
        return F.sqrt(-2 * F.ln(u)) * F.cos(v * 6.283185307179586)

    i, d = F.col("inst_ord"), F.col("date_idx")
    past = Window.partitionBy("inst_ord").orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    cells = spark.range(instruments).select(F.col("id").cast("int").alias("inst_ord")).join(F.broadcast(dates))
    moved = cells.withColumn("r", 0.012 * noise(d, salt=1) * (1 + 0.3 * noise(i, salt=2)) + 0.015 * noise(i, d, salt=3))
    close = 20 * F.exp(F.sum("r").over(past) + 0.03 * noise(i, d, salt=4))
    priced = moved.withColumn("close", close).withColumn("open", F.col("close") * (1 + 0.004 * noise(i, d, salt=5)))
    top, low = F.greatest("open", "close"), F.least("open", "close")
    return priced.select(
        "date", "date_idx", F.format_string("S%04d", i).alias("instrument"), "inst_ord", "open",
        (top * (1 + 0.005 * F.abs(noise(i, d, salt=6)))).alias("high"), (low * (1 - 0.005 * F.abs(noise(i, d, salt=7)))).alias("low"), "close",
        F.exp(13 + 0.4 * noise(i, d, salt=8)).alias("volume"), ((top + low + F.col("close")) / 3).alias("vwap"),
    )


def load_panel(spark: SparkSession, source: str, **options) -> DataFrame:
    if source == "synthetic":
        return synthetic_panel(spark, **options)
    if source == "csv":
        return csv_panel(spark, **options)
    if source == "jdbc":
        return dense(jdbc_prices(spark, **options).drop("amount"))
    raise ValueError(f"unknown source {source!r}")


def universe_asof(grid: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``grid`` with in_universe: membership in the latest snapshot not after the date.

    ``snapshots``: date, instrument. A name absent from that snapshot is out. The few snapshot dates are
    matched to dates first; membership is then an equi-join.
    """
    days, taken = grid.select("date").distinct(), snapshots.select(F.col("date").alias("taken")).distinct()
    latest = days.join(F.broadcast(taken), F.col("taken") <= F.col("date"), "left").groupBy("date").agg(F.max("taken").alias("taken"))
    members = snapshots.select(F.col("date").alias("taken"), "instrument").distinct().withColumn("in_universe", F.lit(True))
    return (
        grid.join(F.broadcast(latest), "date", "left").join(members, ["taken", "instrument"], "left")
        .withColumn("in_universe", F.coalesce("in_universe", F.lit(False))).drop("taken")
    )


def industry_on(grid: DataFrame, intervals: DataFrame) -> DataFrame:
    """``grid`` with the industry whose interval [in_date, out_date) holds the date; a later row overrides.

    ``intervals``: instrument, industry, in_date, out_date (null: open), seq (order of the rows).
    """
    on = (F.col("in_date") <= F.col("date")) & (F.col("out_date").isNull() | (F.col("date") < F.col("out_date")))
    cells = grid.select("date", "instrument").join(intervals, "instrument").where(on)
    last = cells.groupBy("date", "instrument").agg(F.max_by("industry", F.struct("in_date", "seq")).alias("industry"))
    return grid.join(last, ["date", "instrument"], "left")


def most_liquid(prices: DataFrame, n: int, least_presence: float = 0.8) -> DataFrame:
    """instrument, amount, days of the ``n`` with the largest mean amount, present on enough of all dates."""
    days = prices.agg(F.countDistinct("date")).first()[0]
    return (
        prices.groupBy("instrument").agg(F.avg("amount").alias("amount"), F.count("*").alias("days"))
        .where(F.col("days") >= int(least_presence * days)).orderBy(F.desc("amount"), "instrument").limit(n)
    )
