"""Backtests of predictions: full periodic rebalance, and top-k with a bounded exchange a day.

Inputs: pred (date, date_idx, instrument, inst_ord, pred) and returns (date, date_idx, instrument, ret, bench),
``bench`` being the return where the instrument is in the universe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stored import stored

TRADING_DAYS = 252


def book_sizes(pred: DataFrame, share: float, horizon: int, run: str = "run_id") -> dict[str | None, tuple[int, int]]:
    """Of each run (column ``run``; None without it): names held, and names exchanged a day, from the median number of
    predictions a day; halves go to even."""
    pred = pred if run in pred.columns else pred.withColumn(run, F.lit(None).cast("string"))
    daily = pred.groupBy(run, "date").agg(F.count("pred").alias("n")).groupBy(run).agg(F.median("n").alias("n"))
    held = {r[run]: max(1, round(share * int(r.n or 0))) for r in daily.collect()}
    return {name: (k, max(1, round(k / horizon))) for name, k in held.items()}


def book_size(pred: DataFrame, share: float, horizon: int) -> tuple[int, int]:
    return book_sizes(pred.drop("run_id"), share, horizon).get(None, (1, 1))


def _sized(pred: DataFrame, sizes: dict[str | None, tuple[int, int]], run: str) -> DataFrame:
    """``pred`` with __k and __n of its run: as many rows to join as runs."""
    rows = [(name, k, n) for name, (k, n) in sizes.items()]
    return pred.join(F.broadcast(pred.sparkSession.createDataFrame(rows, f"{run} string, __k int, __n int")), run)


def summary(excess: DataFrame, run: str | None = None) -> DataFrame:
    """One row, or one for each run: days, aer (annual excess return) and ir."""
    sd = F.stddev_samp("excess")
    aer = F.avg("excess") * TRADING_DAYS
    of = excess.groupBy(run) if run else excess.groupBy()
    return of.agg(F.count("*").alias("days"), aer.alias("aer"), F.when(sd > 1e-12, aer / (sd * F.sqrt(F.lit(float(TRADING_DAYS))))).alias("ir"))


def periodic_runs(pred: DataFrame, returns: DataFrame, horizon: int, share: float = 0.1, cost: float = 0.0015, run: str = "run_id") -> DataFrame:
    """run_id, date, date_idx, excess: the top names of every ``horizon``-th date of a run held until the next such date.

    Wholly relational: a book depends on its rebalance date alone. A date without predictions keeps the
    book; costs (once on the first buy, twice on what is replaced later) fall on the next date.
    """
    dates = pred.groupBy(run, "date", "date_idx").agg(F.count("pred").alias("n"))
    first = Window.partitionBy(run)
    dates = dates.withColumn("first", F.min("date_idx").over(first))
    place = F.row_number().over(Window.partitionBy(run, "date_idx").orderBy(F.desc("pred"), "inst_ord"))
    on_date = pred.join(F.broadcast(dates.groupBy(run).agg(F.min("date_idx").alias("first"))), run)  # a row for each run
    target = (
        _sized(on_date, book_sizes(pred, share, horizon, run), run).where(F.col("pred").isNotNull() & ((F.col("date_idx") - F.col("first")) % horizon == 0))
        .withColumn("place", place).where(F.col("place") <= F.col("__k")).select(run, F.col("date_idx").alias("since"), "instrument")
    )
    target = stored(target)
    books = target.groupBy(run, "since").agg(F.count("*").alias("size"))
    order = Window.partitionBy(run).orderBy("since")
    books = books.withColumns({"before": F.lag("since").over(order), "was": F.lag("size").over(order)})
    held = target.join(F.broadcast(books), [run, "since"])  # a row for each run and rebalance date
    mine = Window.partitionBy(run, "instrument").orderBy("since")
    kept = held.withColumn("kept", (F.lag("since").over(mine) == F.col("before")).cast("int")).groupBy(run, "since").agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    due = F.when(F.col("before").isNull(), F.lit(cost)).otherwise(cost * 2.0 * (F.col("was") - F.col("kept")) / F.col("size"))
    paid = books.join(kept, [run, "since"]).select(run, (F.col("since") + 1).alias("date_idx"), due.alias("cost"))
    later = dates.where(F.col("date_idx") > F.col("first")).select(run, "date", "date_idx")
    near = [F.col(f"d.{run}") == F.col(f"b.{run}"), F.col("b.since") < F.col("d.date_idx")]
    on = later.alias("d").join(F.broadcast(books.select(run, "since").alias("b")), near, "left").groupBy(f"d.{run}", "d.date", "d.date_idx").agg(F.max("b.since").alias("since"))
    bench = returns.groupBy("date_idx").agg(F.coalesce(F.avg("bench"), F.lit(0.0)).alias("bench"))
    port = on.join(target, [run, "since"]).join(returns.select("date_idx", "instrument", "ret"), ["date_idx", "instrument"]).groupBy(run, "date_idx").agg(F.avg("ret").alias("port"))
    day = on.join(F.broadcast(bench), "date_idx").join(port, [run, "date_idx"], "left").join(paid, [run, "date_idx"], "left")
    port_or = F.when(F.col("since").isNull(), F.lit(0.0)).otherwise(F.coalesce("port", "bench"))
    return day.select(run, "date", "date_idx", (port_or - F.col("bench") - F.coalesce("cost", F.lit(0.0))).alias("excess"))


def periodic(pred: DataFrame, returns: DataFrame, horizon: int, share: float = 0.1, cost: float = 0.0015) -> DataFrame:
    """``periodic_runs`` of one run: date, date_idx, excess."""
    return periodic_runs(pred.withColumn("run_id", F.lit("run")), returns, horizon, share, cost).drop("run_id")


def folded(batches: Iterator[pa.RecordBatch], k: int, n: int, cost: float, sizes: dict[str, tuple[int, int]] | None = None) -> Iterator[pa.RecordBatch]:
    """run, date_idx, instrument, due: what is held on each date of a run but its first, and costs in a row without instrument.

    Takes rows (run, date_idx, instrument) in the order of run, date and rank, of which one date is held at a
    time; a row without instrument stands for a date that may have no ranks. ``sizes``: k and n of the runs that have their own.
    """

    def book(run: str, day: int, held: list[str], due: float) -> pa.RecordBatch:
        m = len(held) + 1
        cols = [pa.array([run] * m, pa.string()), pa.array([day] * m, pa.int32()), pa.array([None, *held], pa.string()), pa.array([due] + [0.0] * len(held))]
        return pa.record_batch(cols, ["run", "date_idx", "instrument", "due"])

    ids: dict[str, int] = {}

    def dates() -> Iterator[tuple[str, int, np.ndarray]]:
        now, ranked = None, []
        for b in batches:
            if not b.num_rows:
                continue
            runs, days = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            of = runs.indices.to_numpy()
            code = np.fromiter((-1 if s is None else ids.setdefault(s, len(ids)) for s in b.column(2).to_pylist()), np.int64, b.num_rows)
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (days[1:] != days[:-1])) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if (key := (runs.dictionary[int(of[i])].as_py(), int(days[i]))) != now:
                    if now:
                        yield *now, np.concatenate(ranked)
                    now, ranked = key, []
                part = code[i:j]
                ranked.append(part[part >= 0])
        if now:
            yield *now, np.concatenate(ranked)

    def among(some: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(ids), bool)
        mask[some] = True
        return mask

    none = np.empty(0, np.int64)
    last, held, due, names = None, none, 0.0, []
    for run, day, ranked in dates():
        if len(names) < len(ids):
            names = list(ids)
        if run == last:
            yield book(run, day, [names[i] for i in held.tolist()], due)
            due = 0.0
        else:
            last, held, due = run, none, 0.0
            k, n = (sizes or {}).get(run, (k, n))
        if not len(ranked):
            continue
        top = ranked[:k]
        if not len(held):
            held, due = top, cost
            continue
        place = np.full(len(ids), len(ranked))
        place[ranked] = np.arange(len(ranked))
        out = held[~among(top)[held]]
        sells = out[np.argsort(-place[out], kind="stable")][:n]
        buys = ranked[~among(held)[ranked]][: len(sells)]
        if len(sells) and len(buys):
            held = np.concatenate([held[~among(sells)[held]], buys])
            due = cost * (len(sells) + len(buys)) / max(len(held), 1)


def top_k_drop_n(pred: DataFrame, returns: DataFrame, horizon: int, share: float = 0.1, cost: float = 0.0015, run: str = "run_id") -> DataFrame:
    """run_id, date, date_idx, excess: at most n names exchanged a day, worst held for best not held.

    Each day's book depends on the day before, so a run is a fold over its dates, in time order and with one
    date's names in memory; ranks before it and returns after it are relational. Only names that were within the first
    k + n of some date go through the fold, as no others can be bought; so what one task folds follows the book, not
    the market. ``pred`` may hold many runs in column ``run``, each with a book of its own size; they go side by side.
    """
    pred = pred if run in pred.columns else pred.withColumn(run, F.lit("run"))
    sizes = {str(name): size for name, size in book_sizes(pred, share, horizon, run).items()}
    rows = (
        pred.join(returns.select("date_idx", "instrument", "ret", "bench"), ["date_idx", "instrument"])
        .select(F.col(run).cast("string").alias("run"), "date", F.col("date_idx").cast("int").alias("date_idx"), "instrument", "inst_ord", "pred", "ret", "bench")
    )
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    days = rows.groupBy("run", "date_idx").agg(F.min("date").alias("date"), F.coalesce(F.avg(value("bench")), F.lit(0.0)).alias("bench"))
    place = F.row_number().over(Window.partitionBy("run", "date_idx").orderBy(F.desc("pred"), "inst_ord"))
    ranked = rows.where(value("pred").isNotNull()).select("run", "date_idx", F.col("instrument").cast("string").alias("instrument"), place.alias("place"))
    if sizes:
        near = _sized(ranked, sizes, "run").where(F.col("place") <= F.col("__k") + F.col("__n")).select("run", "instrument").distinct()
        ranked = ranked.join(near, ["run", "instrument"], "left_semi")
    dates = days.select("run", "date_idx", F.lit(None).cast("string").alias("instrument"), F.lit(0).alias("place"))
    ordered = ranked.unionByName(dates).repartition("run").sortWithinPartitions("run", "date_idx", "place").select("run", "date_idx", "instrument")
    books = ordered.mapInArrow(lambda b: folded(b, 1, 1, cost, sizes), "run string, date_idx int, instrument string, due double")
    paid = rows.select("run", "date_idx", F.col("instrument").cast("string").alias("instrument"), value("ret").alias("ret"))
    held = books.join(paid, ["run", "date_idx", "instrument"], "left").groupBy("run", "date_idx").agg(
        F.max("due").alias("due"), F.count("instrument").alias("names"), F.avg("ret").alias("mean")
    )
    port = F.when(F.col("names") == 0, F.lit(0.0)).otherwise(F.coalesce("mean", "bench"))
    return held.join(days, ["run", "date_idx"]).select(F.col("run").alias(run), "date", "date_idx", (port - F.col("bench") - F.col("due")).alias("excess"))
