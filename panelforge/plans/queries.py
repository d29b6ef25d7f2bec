"""The registered factor queries and, where SQL can express them, the same in DuckDB SQL.

All of them read the given tables: bars come from order lines, by supplier and month (or brand and week),
so that their work grows with these. Results are rounded where engines add floats in another order.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.factors import operators
from panelforge.functions.stored import shared_folder, stored
from panelforge.operators import backtest, combine, evaluation, longshort, metrics, neutralize, reports, robustness, zoo
from panelforge.operators.gram import gram
from panelforge.plans.compiler import factor_values, wide
from panelforge.plans.formula import Formula, Node, Step
from panelforge.plans.subtrees import closed_genes, gene_table
from panelforge.plans.templates import TEMPLATES, formula_of
from panelforge.search import tree as search
from panelforge.sources import industry
from panelforge.sources import panel as P

HORIZON = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- SQL that the oracles share


def _bars(source: str, instrument: str, period: str) -> str:
    key = "l_shipdate, l_orderkey, l_linenumber, price, l_quantity"
    return f"""
l0 as (select *, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 price, {instrument} instrument, {period} date from {source}),
bars as (select instrument, date, arg_min(price, row({key})) "open", max(price) high, min(price) low, arg_max(price, row({key})) "close",
    sum(l_quantity) volume, floor(sum(price * l_quantity) / sum(l_quantity) * 10000 + 0.5) / 10000 vwap from l0 group by all)"""


_DENSE = """,
dates as (select date, (row_number() over (order by date) - 1)::int date_idx from (select distinct date from bars)),
names as (select instrument, (row_number() over (order by {order}) - 1)::int inst_ord from (select distinct instrument from bars)),
panel as (select d.date, d.date_idx, i.instrument, i.inst_ord, "open", high, low, "close", volume, vwap
    from dates d cross join names i left join bars b on b.date = d.date and b.instrument = i.instrument)"""
SM_BARS = _bars("lineitem", "l_suppkey::varchar", "date_trunc('month', l_shipdate)::date")
SM = SM_BARS + _DENSE.format(order="instrument::bigint")
BW = _bars("lineitem join part on l_partkey = p_partkey", "p_brand", "date_trunc('week', l_shipdate)::date") + _DENSE.format(order="instrument")
W = "(partition by instrument order by date_idx)"


def win(t: int) -> str:
    return f"(partition by instrument order by date_idx rows between {t - 1} preceding and current row)"


def fin(x: str) -> str:
    return f"(case when isfinite({x}) then {x} end)"


def full(x: str, t: int, e: str) -> str:
    return f"(case when count({x}) over {win(t)} = {t} then {fin(e)} end)"


#: f: Zscore(Ma(close - vwap, 4), 8); g: Neg(Pct(close, 2)); and the forward return over HORIZON months
_F = f"""
p1 as (select *, "close" - vwap d, {fin(f'lead("close", {HORIZON}) over {W} / nullif("close", 0) - 1')} fwd,
    {fin(f'lead("close", 1) over {W} / nullif("close", 0) - 1')} ret1,
    -{fin(f'"close" / nullif(lag("close", 2) over {W}, 0) - 1')} g from panel),
p2 as (select *, {full("d", 4, f"avg(d) over {win(4)}")} m from p1),
p3 as (select *, {full("m", 8, f"(m - avg(m) over {win(8)}) / nullif(stddev_samp(m) over {win(8)}, 0)")} f from p2)"""
VALUES = f"""{SM}, {_F},
fv as (select 'f' factor_id, date, date_idx, instrument, inst_ord, f "value", fwd, ret1 from p3
    union all select 'g', date, date_idx, instrument, inst_ord, g, fwd, ret1 from p3)"""


def ranked(x: str, name: str) -> str:
    return f"""case when {x} is not null then (rank() over (partition by factor_id, date order by {x} nulls last)
        + (count(*) over (partition by factor_id, date, {x}) - 1) / 2::double) / count({x}) over (partition by factor_id, date) end {name}"""


def pearson(source: str, x: str, y: str, name: str) -> str:
    return f"""{name}0 as (select factor_id, date, date_idx, {x} - avg({x}) over w x, {y} - avg({y}) over w y from {source}
        where {x} is not null and {y} is not null window w as (partition by factor_id, date)),
    {name} as (select factor_id, date, date_idx, case when count(*) >= 3 and sum(x * x) * sum(y * y) > 0
        then sum(x * y) / sqrt(sum(x * x) * sum(y * y)) end ic from {name}0 group by all)"""


RANKS = f"rk as (select *, {ranked('value', 'rv')}, {ranked('fwd', 'rf')} from fv)"
RANK_IC = f"{VALUES}, {RANKS}, {pearson('rk', 'rv', 'rf', 'ric')}"

# ---------------------------------------------------------------- the Spark side of the same


def steps(*each: tuple[str, list[int], list[str]], out: str = "x") -> Node:
    """The last of a chain of (operator, parameters, inputs); "$1", "$2" name earlier results."""
    body, args = [], {}
    for i, (op, params, inputs) in enumerate(each, 1):
        names = [f"p{i}_{j}" for j in range(len(params))]
        args |= dict(zip(names, params))
        body.append(Step(op, names, [x.replace("$", out) for x in inputs], f"{out}{i}"))
    return Formula("q", "", body, [args]).tree(args)


SIGNAL = steps(("Sub", [], ["close", "vwap"]), ("Ma", [4], ["$1"]), ("Zscore", [8], ["$2"]))
REVERSAL = steps(("Pct", [2], ["close"]), ("Neg", [], ["$1"]))


def with_forward(panel: DataFrame, h: int = HORIZON) -> DataFrame:
    return panel.withColumns({"fwd": P.forward_return(h), "ret1": P.forward_return(1)})


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_values(with_forward(P.supplier_panel(spark, sf_dir)), {"f": SIGNAL, "g": REVERSAL}, ("fwd", "ret1"))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def r6(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# ---------------------------------------------------------------- 33 operators, each on its own

RET = f"""{SM}, p as (select *, {fin(f'"close" / nullif(lag("close", 1) over {W}, 0) - 1')} ret from panel)"""
PCT = ("Pct", [1], ["close"])


def _corr(x: str, y: str, t: int) -> str:
    a, b = f"(case when {y} is not null then {x} end)", f"(case when {x} is not null then {y} end)"
    sd = f"(stddev_samp({a}) over {win(t)} * stddev_samp({b}) over {win(t)})"
    return full(a, t, f"covar_samp({x}, {y}) over {win(t)} / nullif({sd}, 0)")


def _moment(kind: str, t: int, flat: str) -> str:
    inner = f"case when min(ret) over {win(t)} = max(ret) over {win(t)} then {flat} when var_pop(ret) over {win(t)} > 1e-14 then {kind}(ret) over {win(t)} end"
    return f"(case when count(ret) over {win(t)} = {t} then {inner} end)"


#: operator: (tree, SQL over p). ``ret`` is the one-month return.
_CASES: dict[str, tuple[Node, str]] = {
    "Neg": (steps(PCT, ("Neg", [], ["$1"])), "-ret"),
    "Abs": (steps(PCT, ("Abs", [], ["$1"])), "abs(ret)"),
    "Square": (steps(PCT, ("Square", [], ["$1"])), "ret * ret"),
    "Inverse": (steps(("Inverse", [], ["close"])), '1 / nullif("close", 0)'),
    "Sign": (steps(PCT, ("Sign", [], ["$1"])), "sign(ret)::double"),
    "Sin": (steps(PCT, ("Sin", [], ["$1"])), "sin(ret)"),
    "Cos": (steps(PCT, ("Cos", [], ["$1"])), "cos(ret)"),
    "Tanh": (steps(PCT, ("Tanh", [], ["$1"])), "tanh(ret)"),
    "Log": (steps(PCT, ("Log", [], ["$1"])), "case when ret > 0 then ln(ret) end"),
    "Delay": (steps(("Delay", [3], ["close"])), f'lag("close", 3) over {W}'),
    "Diff": (steps(("Diff", [3], ["close"])), f'"close" - lag("close", 3) over {W}'),
    "Pct": (steps(PCT), "ret"),
    "Ma": (steps(("Ma", [5], ["close"])), full('"close"', 5, f'avg("close") over {win(5)}')),
    "Med": (steps(("Med", [6], ["close"])), full('"close"', 6, f'median("close") over {win(6)}')),
    "Sum": (steps(("Sum", [5], ["volume"])), full("volume", 5, f"sum(volume) over {win(5)}")),
    "Std": (steps(PCT, ("Std", [6], ["$1"])), full("ret", 6, f"stddev_samp(ret) over {win(6)}")),
    "Max": (steps(("Max", [6], ["high"])), full("high", 6, f"max(high) over {win(6)}")),
    "Min": (steps(("Min", [6], ["low"])), full("low", 6, f"min(low) over {win(6)}")),
    "Rank": (
        steps(("Rank", [6], ["volume"])),
        full("volume", 6, f"(len(list_filter(list(volume) over {win(6)}, lambda v: v < volume)) + (len(list_filter(list(volume) over {win(6)}, lambda v: v = volume)) + 1) / 2.0) / 6"),
    ),
    "Skew": (steps(PCT, ("Skew", [8], ["$1"])), _moment("skewness", 8, "0.0")),
    "Kurt": (steps(PCT, ("Kurt", [8], ["$1"])), _moment("kurtosis", 8, "-3.0")),
    "Vari": (steps(("Vari", [6], ["volume"])), full("volume", 6, f"stddev_samp(volume) over {win(6)} / nullif(avg(volume) over {win(6)}, 0)")),
    "Zscore": (steps(("Zscore", [6], ["close"])), full('"close"', 6, f'("close" - avg("close") over {win(6)}) / nullif(stddev_samp("close") over {win(6)}, 0)')),
    "Autocorr": (steps(PCT, ("Autocorr", [8, 2], ["$1"])), _corr("ret", "ret2", 8)),
    "Add": (steps(("Add", [], ["high", "low"])), "high + low"),
    "Sub": (steps(("Sub", [], ["close", "vwap"])), '"close" - vwap'),
    "Mul": (steps(PCT, ("Mul", [], ["$1", "volume"])), "ret * volume"),
    "Div": (steps(("Div", [], ["close", "open"])), '"close" / nullif("open", 0)'),
    "Greater": (steps(("Greater", [], ["close", "vwap"])), '("close" > vwap)::int::double'),
    "Less": (steps(("Less", [], ["close", "vwap"])), '("close" < vwap)::int::double'),
    "Cov": (steps(PCT, ("Cov", [6], ["$1", "volume"])), full("(case when ret is not null then volume end)", 6, f"covar_samp(ret, volume) over {win(6)}")),
    "Corr": (steps(("Corr", [6], ["close", "volume"])), _corr('"close"', "volume", 6)),
    "TsRegress": (
        steps(PCT, ("TsRegress", [6], ["volume", "$1"])),
        full("(case when ret is not null then volume end)", 6, f"covar_samp(volume, ret) over {win(6)} / nullif(var_samp(case when ret is not null then volume end) over {win(6)}, 0)"),
    ),
}


#: a tree with each operator at its root
OPERATOR_TREES = {name: tree for name, (tree, _) in _CASES.items()}


def _op_query(tree: Node):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return wide(P.supplier_panel(spark, sf_dir), {"value": tree}).select("date", "instrument", r6("value").alias("value"))

    return run


for _op in operators():
    _tree, _sql = _CASES[_op.name]
    query(
        f"op_{_op.name.lower()}",
        f'with {RET}, q as (select *, lag(ret, 2) over {W} ret2 from p) select date, instrument, round({fin(_sql) if "case" not in _sql[:6] else _sql}, 6) as "value" from q',
    )(_op_query(_tree))

# ---------------------------------------------------------------- panels


def _bars_of(bars):
    return lambda spark, sf_dir: bars(spark, sf_dir).select("instrument", "date", "open", "high", "low", "close", "volume", "vwap")


for _name, _read, _sql in (("bars_sm", P.supplier_months, SM_BARS), ("bars_bw", P.brand_weeks, BW.split(",\ndates")[0])):
    query(_name, f'with {_sql} select instrument, date, "open", high, low, "close", volume, vwap from bars')(_bars_of(_read))


@query("densify", f'with {SM} select date, date_idx, instrument, inst_ord, "close", volume from panel')
def _(spark, sf_dir):
    return P.supplier_panel(spark, sf_dir).select("date", "date_idx", "instrument", "inst_ord", "close", "volume")


@query("forward_returns", f'with {SM}, {_F} select date, instrument, round(fwd, 6) as fwd from p3')
def _(spark, sf_dir):
    return with_forward(P.supplier_panel(spark, sf_dir)).select("date", "instrument", r6("fwd").alias("fwd"))


_FILL = f"""f0 as (select *, last_value("close" ignore nulls) over (partition by instrument order by date_idx rows between unbounded preceding and current row) c from panel),
f1 as (select *, {fin(f"c / nullif(lag(c) over {W}, 0) - 1")} ret from f0)"""


@query("daily_returns_pad", f"with {SM}, {_FILL} select date, instrument, round(ret, 6) as ret from f1")
def _(spark, sf_dir):
    return P.supplier_panel(spark, sf_dir).select("date", "instrument", r6(P.daily_return()).alias("ret"))


@query(
    "period_split",
    f"with {SM}, c as (select count(*) n from dates) select date, instrument, date_idx <= greatest(least(floor(n * 0.7) - 1, n - 1), 0) as train from panel, c",
)
def _(spark, sf_dir):
    p = P.supplier_panel(spark, sf_dir)
    n = p.agg(F.max("date_idx") + 1).first()[0]
    return p.select("date", "instrument", (F.col("date_idx") <= P.split_at(n, 0.7)).alias("train"))


# ---------------------------------------------------------------- cross-sectional metrics


@query("cs_rank", f"with {VALUES}, {RANKS} select factor_id, date, instrument, round(rv, 6) as rank from rk")
def _(spark, sf_dir):
    return values(spark, sf_dir).select("factor_id", "date", "instrument", r6(metrics.cs_rank("value")).alias("rank"))


@query("ic", f"with {VALUES}, {pearson('fv', 'value', 'fwd', 'c')} select factor_id, date, round(ic, 6) as ic from c")
def _(spark, sf_dir):
    return metrics.daily_ic(values(spark, sf_dir)).select("factor_id", "date", r6("ic").alias("ic"))


@query("rank_ic", f"with {RANK_IC} select factor_id, date, round(ic, 6) as ic from ric")
def _(spark, sf_dir):
    return metrics.daily_rank_ic(values(spark, sf_dir)).select("factor_id", "date", r6("ic").alias("ic"))


@query("mean_ir", f"with {RANK_IC} select factor_id, round(avg(ic), 6) as mean, round(case when stddev_samp(ic) > 1e-12 then avg(ic) / stddev_samp(ic) end, 6) as ir from ric group by 1")
def _(spark, sf_dir):
    return metrics.mean_and_ir(metrics.daily_rank_ic(values(spark, sf_dir))).select("factor_id", r6("mean").alias("mean"), r6("ir").alias("ir"))


@query("coverage", f"with {VALUES} select factor_id, round(count(value) / count(*)::double, 6) as coverage from fv group by 1")
def _(spark, sf_dir):
    return metrics.coverage(values(spark, sf_dir)).select("factor_id", r6("coverage").alias("coverage"))


TOP = f"""{VALUES}, t0 as (select *, greatest(count(value) over (partition by factor_id, date) * 0.1, 1.0) k0,
    row_number() over (partition by factor_id, date order by value desc nulls last, inst_ord) pos from fv),
tw as (select *, round_even(k0, 0) k, case when value is not null and pos <= round_even(k0, 0) then 1 / round_even(k0, 0) else 0.0 end weight from t0)"""


@query("top_weights", f"with {TOP} select factor_id, date, instrument, round(weight, 6) as weight from tw")
def _(spark, sf_dir):
    return metrics.top_weights(values(spark, sf_dir)).select("factor_id", "date", "instrument", r6("weight").alias("weight"))


@query(
    "turnover",
    f"""with {TOP}, a as (select *, sum(weight) over (partition by factor_id, date) > 0 active from tw),
    m as (select factor_id, date, abs(weight - lag(weight) over (partition by factor_id, instrument order by date_idx)) d from a where active),
    y as (select factor_id, date, sum(d) t from m group by all) select factor_id, round(avg(t), 6) as turnover from y group by 1""",
)
def _(spark, sf_dir):
    return metrics.daily_turnover(values(spark, sf_dir)).select("factor_id", r6("turnover").alias("turnover"))


FACTOR_CORR = f"""{VALUES}, {RANKS}, pr as (select 'fg' factor_id, a.date, a.date_idx, a.rv x0, b.rv y0 from rk a join rk b using (date, instrument)
    where a.factor_id = 'f' and b.factor_id = 'g'), {pearson('pr', 'x0', 'y0', 'fc')}"""


@query("factor_corr", f"with {FACTOR_CORR} select 'f' as factor_id, 'g' as other_id, round(avg(ic), 6) as corr from fc")
def _(spark, sf_dir):
    return metrics.factor_correlation(values(spark, sf_dir)).select("factor_id", "other_id", r6("corr").alias("corr"))


# ---------------------------------------------------------------- long-short

BUCKETS = f"""{VALUES}, b0 as (select *, row_number() over (partition by factor_id, date order by value nulls last, inst_ord)
    / count(value) over (partition by factor_id, date)::double share from fv where value is not null),
bk as (select *, least(5, greatest(1, ceil(share * 5)))::int bucket from b0)"""
MEANS = f"""{BUCKETS}, bd as (select factor_id, date, bucket, avg(fwd) r from bk group by all),
bm as (select factor_id, bucket, avg(r) mean_return from bd group by all)"""
LS = f"""{BUCKETS}, ls as (select * from (select factor_id, date, date_idx, avg(case when bucket = 5 then ret1 end) - avg(case when bucket = 1 then ret1 end) ret
    from bk group by all) where ret is not null)"""
MONO = """mono as (select factor_id, avg((d >= 0)::int::double) monotonic from (select factor_id, mean_return
    - lag(mean_return) over (partition by factor_id order by bucket) d from bm where mean_return is not null) group by 1)"""
SHARPE = "sh as (select factor_id, case when count(ret) >= 20 and stddev_samp(ret) >= 1e-12 then avg(ret) / stddev_samp(ret) * sqrt(252.0) end sharpe from ls group by 1)"


def next_period(values: DataFrame) -> DataFrame:
    """Long-short portfolios are held for one period: returns over several would overlap."""
    return values.withColumn("fwd", F.col("ret1"))


@query("quantile_labels", f"with {BUCKETS} select factor_id, date, instrument, bucket from bk")
def _(spark, sf_dir):
    return longshort.quantile_labels(values(spark, sf_dir)).where("bucket is not null").select("factor_id", "date", "instrument", "bucket")


@query("quantile_means", f"with {MEANS} select factor_id, bucket, round(mean_return, 6) as mean_return from bm")
def _(spark, sf_dir):
    return longshort.quantile_means(values(spark, sf_dir)).select("factor_id", "bucket", r6("mean_return").alias("mean_return"))


@query("monotonic_fraction", f"with {MEANS}, {MONO} select factor_id, round(monotonic, 6) as monotonic from mono")
def _(spark, sf_dir):
    return longshort.monotonic_fraction(longshort.quantile_means(values(spark, sf_dir))).select("factor_id", r6("monotonic").alias("monotonic"))


@query("ls_returns", f"with {LS} select factor_id, date, round(ret, 6) as ret from ls")
def _(spark, sf_dir):
    return longshort.long_short_returns(next_period(values(spark, sf_dir))).select("factor_id", "date", r6("ret").alias("ret"))


@query("ls_sharpe", f"with {LS}, {SHARPE} select factor_id, round(sharpe, 6) as sharpe from sh")
def _(spark, sf_dir):
    return longshort.annual_sharpe(longshort.long_short_returns(next_period(values(spark, sf_dir)))).select("factor_id", r6("sharpe").alias("sharpe"))


@query(
    "monotonicity_score",
    f"""with {MEANS}, {LS.split(BUCKETS + ", ")[1]}, {MONO}, {SHARPE},
    sp as (select factor_id, max(case when bucket = 5 then mean_return end) - max(case when bucket = 1 then mean_return end) s from bm group by 1)
    select factor_id, round(case when s > 0 then 0.4 * coalesce(monotonic, 0) + 0.6 * coalesce(least(1, greatest(0, sharpe / 2)), 0) else 0.0 end, 6) as score
    from sp left join mono using (factor_id) left join sh using (factor_id)""",
)
def _(spark, sf_dir):
    v = values(spark, sf_dir)
    means = longshort.quantile_means(v)
    parts = longshort.quantile_spread(means).join(longshort.monotonic_fraction(means), "factor_id", "left")
    parts = parts.join(longshort.annual_sharpe(longshort.long_short_returns(next_period(v))), "factor_id", "left")
    return parts.select("factor_id", r6(longshort.monotonicity_score(F.col("spread"), F.col("monotonic"), F.col("sharpe"))).alias("score"))


@query(
    "deciles",
    f"""with {VALUES}, {RANKS} select factor_id, least(10, greatest(1, ceil(rv * 10)))::int as bucket, round(avg(fwd), 6) as mean_return, count(*) as cells
    from rk where rv is not null and fwd is not null group by 1, 2""",
)
def _(spark, sf_dir):
    return longshort.decile_table(values(spark, sf_dir)).select("factor_id", "bucket", r6("mean_return").alias("mean_return"), "cells")


# ---------------------------------------------------------------- reports by period

SPLIT = "sp as (select greatest(least(floor(count(*) * 0.7)::int - 1, count(*) - 1), 0) s from dates)"


def _last_train(df: DataFrame) -> int:
    return P.split_at(df.agg(F.max("date_idx") + 1).first()[0], 0.7)


def _ic_ir(on: str, name: str) -> str:
    x = f"case when {on} then ic end"
    return f"round(avg({x}), 6) as rank_ic_{name}, round(case when stddev_samp({x}) > 1e-12 then avg({x}) / stddev_samp({x}) end, 6) as rank_ir_{name}"


@query(
    "period_report",
    f"""with {RANK_IC}, {SPLIT}, r as (select factor_id, avg(case when date_idx <= s then ic end) a, avg(case when date_idx > s then ic end) b,
    {_ic_ir("date_idx <= s", "train")}, {_ic_ir("date_idx > s", "valid")} from ric, sp group by 1)
    select * exclude (a, b), coalesce(a * b < 0, false) as sign_flip,
    case when a is null or b is null or abs(a) < 1e-12 then 1.0 when b / a <= 0 then 0.2 when b / a < 0.3 then 0.6 when b / a < 0.7 then 0.85 else 1.0 end::double as generalization from r""",
)
def _(spark, sf_dir):
    daily = metrics.daily_rank_ic(values(spark, sf_dir))
    out = reports.period_report(daily, _last_train(P.supplier_panel(spark, sf_dir)))
    return out.select("factor_id", *(r6(f"{m}_{p}").alias(f"{m}_{p}") for m in ("rank_ic", "rank_ir") for p in ("train", "valid")), "sign_flip", "generalization")


_PERIODS = VALUES.replace("fv as (", "fv0 as (") + f""", {SPLIT},
fv as (select factor_id || '|' || case when date_idx <= s then 'train' else 'valid' end factor_id, * exclude (factor_id, s) from fv0, sp)"""


@query(
    "longshort_report",
    f"""with {MEANS.replace(VALUES, _PERIODS)}, {LS.split(BUCKETS + ", ")[1]}, {MONO}, {SHARPE}, {RANKS}, {pearson('rk', 'rv', 'rf', 'ric')},
    q as (select factor_id, max(case when bucket = 5 then mean_return end) - max(case when bucket = 1 then mean_return end) spread from bm group by 1),
    ri as (select factor_id, avg(ic) rank_ic from ric group by 1)
    select split_part(factor_id, '|', 1) as factor_id, split_part(factor_id, '|', 2) as period, round(spread, 6) as spread, round(monotonic, 6) as monotonic,
    round(sharpe, 6) as sharpe, round(rank_ic, 6) as rank_ic, coalesce(spread > 0 and monotonic >= 0.75 and sharpe >= 1, false) as passes
    from q left join mono using (factor_id) left join sh using (factor_id) left join ri using (factor_id)""",
)
def _(spark, sf_dir):
    out = reports.longshort_report(values(spark, sf_dir), _last_train(P.supplier_panel(spark, sf_dir)))
    return out.select("factor_id", "period", *(r6(c).alias(c) for c in ("spread", "monotonic", "sharpe", "rank_ic")), "passes")


DEMEANED = f"""{BUCKETS}, dm0 as (select *, ret1 - avg(ret1) over (partition by factor_id, date) r0 from bk where ret1 is not null),
dm as (select factor_id, date, date_idx, bucket, avg(r0) r from dm0 group by all),
sr as (select * from (select factor_id, date, date_idx, max(case when bucket = 5 then r end) - max(case when bucket = 1 then r end) ret from dm group by all) where ret is not null)"""


@query(
    "tear_sheet",
    f"""with {DEMEANED}, {RANKS}, {pearson('rk', 'rv', 'rf', 'ric')},
    i0 as (select *, (row_number() over (partition by factor_id order by date_idx) - 1) % {HORIZON} = 0 apart from ric where ic is not null),
    i1 as (select factor_id, avg(ic) m, stddev_samp(ic) s, avg(case when apart then ic end) gm, stddev_samp(case when apart then ic end) gs from i0 group by 1),
    l1 as (select factor_id, avg(ret) m2, stddev_samp(ret) s2, product(1 + ret) - 1 t from sr group by 1)
    select factor_id, round(m, 6) as mean_ic, round(case when s > 1e-12 then m / s end, 6) as icir, round(case when gs > 1e-12 then gm / gs end, 6) as icir_gap,
    round(case when s2 > 1e-12 then m2 / s2 * sqrt(252.0) end, 6) as ls_sharpe, round(log10(abs(t + 1)), 6) as ls_growth_log10 from i1 left join l1 using (factor_id)""",
)
def _(spark, sf_dir):
    sheet = reports.tear_sheet(values(spark, sf_dir), HORIZON)
    growth = F.log10(F.abs(F.col("ls_total") + 1))  # over many months it has too many digits to compare
    return sheet.select("factor_id", *(r6(c).alias(c) for c in ("mean_ic", "icir", "icir_gap", "ls_sharpe")), r6(growth).alias("ls_growth_log10"))


@query(
    "tear_curves",
    f"""with {DEMEANED} select factor_id, bucket, date, round(log10(abs(product(1 + r) over (partition by factor_id, bucket order by date_idx rows unbounded preceding))), 6) as growth_log10 from dm""",
)
def _(spark, sf_dir):
    curves = reports.cumulative(reports.demeaned_returns(values(spark, sf_dir)), ("factor_id", "bucket"), "r")
    return curves.select("factor_id", "bucket", "date", r6(F.log10(F.abs("growth"))).alias("growth_log10"))


#: fv cut to rows with both returns, on dates whose quantile edges differ; buckets by value
BY_VALUE = """cl as (select * from fv where value is not null and fwd is not null and ret1 is not null),
se as (select factor_id, date, list_sort(list(value)) l, count(*) m from cl group by all),
ed as (select factor_id, date, list_transform(range(0, 6), lambda k: l[(k * (m - 1)) // 5 + 1] + (l[least((k * (m - 1)) // 5 + 2, m)] - l[(k * (m - 1)) // 5 + 1]) * ((k * (m - 1)) % 5) / 5.0::double) e from se),
bv as (select cl.*, 1 + (value > e[2])::int + (value > e[3])::int + (value > e[4])::int + (value > e[5])::int bucket from cl join ed using (factor_id, date)
    where e[1] < e[2] and e[2] < e[3] and e[3] < e[4] and e[4] < e[5] and e[5] < e[6])"""


@query("value_buckets", f"with {VALUES}, {BY_VALUE} select factor_id, date, instrument, bucket from bv")
def _(spark, sf_dir):
    return reports.value_buckets(values(spark, sf_dir)).select("factor_id", "date", "instrument", "bucket")


_SHEET = ", ".join(
    f"round(max(case when period = '{p}' then {c} end), 6) as {p}_{c}" for p in ("train", "valid") for c in ("ic", "icir", "icir_gap", "ls_sharpe")
)


@query(
    "value_tear_sheet",
    f"""with {VALUES}, {BY_VALUE}, {SPLIT}, pb as (select factor_id || '|' || case when date_idx <= s then 'train' else 'valid' end factor_id, bv.* exclude (factor_id) from bv, sp),
    {RANKS.replace("from fv", "from pb")}, {pearson('rk', 'rv', 'rf', 'ric')},
    i0 as (select *, (row_number() over (partition by factor_id order by date_idx) - 1) % {HORIZON} = 0 apart from ric where ic is not null),
    i1 as (select factor_id, avg(ic) ic, case when stddev_samp(ic) > 1e-12 then avg(ic) / stddev_samp(ic) end icir,
        case when stddev_samp(case when apart then ic end) > 1e-12 then avg(case when apart then ic end) / stddev_samp(case when apart then ic end) end icir_gap from i0 group by 1),
    d0 as (select *, ret1 - avg(ret1) over (partition by factor_id, date) r0 from pb), d1 as (select factor_id, date, bucket, avg(r0) r from d0 group by all),
    d2 as (select factor_id, date, max(case when bucket = 5 then r end) - max(case when bucket = 1 then r end) ret from d1 group by all),
    d3 as (select factor_id, case when stddev_samp(ret) > 1e-12 then avg(ret) / stddev_samp(ret) * sqrt(252.0) end ls_sharpe from d2 group by 1),
    al as (select split_part(factor_id, '|', 1) factor_id, split_part(factor_id, '|', 2) period, ic, icir, icir_gap, ls_sharpe from i1 left join d3 using (factor_id))
    select factor_id, {_SHEET} from al group by 1""",
)
def _(spark, sf_dir):
    """Tear-sheet statistics by value quantiles, of the training dates and those after."""
    v = values(spark, sf_dir)
    n = P.supplier_panel(spark, sf_dir).agg(F.max("date_idx") + 1).first()[0]
    last = P.split_at(n, 0.7)
    out = reports.value_tear_sheet(v, HORIZON, {"train": (0, last), "valid": (last + 1, n - 1)})
    return out.select("factor_id", *(r6(c).alias(c) for c in out.columns if c != "factor_id"))


@query(
    "rolling_ic",
    f"""with {RANK_IC} select factor_id, date, round(ic, 6) as ic, round(case when count(*) over w >= 6 then avg(ic) over w end, 6) as rolling,
    round(sum(ic) over (partition by factor_id order by date_idx), 6) as total from ric where ic is not null window w as (partition by factor_id order by date_idx rows 11 preceding)""",
)
def _(spark, sf_dir):
    """A year of months, half of them at least."""
    out = reports.rolling_ic(metrics.daily_rank_ic(values(spark, sf_dir)), 12, 6)
    return out.select("factor_id", "date", *(r6(c).alias(c) for c in ("ic", "rolling", "total")))


# ---------------------------------------------------------------- robustness


@query(
    "block_fraction",
    f"""with {RANK_IC}, n as (select *, ntile(4) over (partition by factor_id order by date_idx) block from ric where ic is not null),
    m as (select factor_id, block, avg(ic) m, count(*) n from n group by all)
    select factor_id, round(case when sum(n) >= 40 then avg((m > 0)::int::double) end, 6) as fraction from m group by 1""",
)
def _(spark, sf_dir):
    return robustness.block_fraction(metrics.daily_rank_ic(values(spark, sf_dir)), 4, 10).select("factor_id", r6("fraction").alias("fraction"))


@query(
    "year_fraction",
    f"""with {RANK_IC}, m as (select factor_id, year(date) y, avg(ic) m from ric where ic is not null group by all having count(*) >= 5)
    select factor_id, round(avg((m > 0)::int::double), 6) as fraction from m group by 1""",
)
def _(spark, sf_dir):
    return robustness.year_fraction(metrics.daily_rank_ic(values(spark, sf_dir)), 5).select("factor_id", r6("fraction").alias("fraction"))


@query(
    "asset_mismatch",
    f"""with {VALUES}, nn as (select count(*) n from names),
    sv as (select a.factor_id, a.date, a.date_idx, a.instrument, a.inst_ord, b.value "value", a.fwd from fv a, nn
        join fv b on b.factor_id = a.factor_id and b.date = a.date and (b.inst_ord + 1) % n = a.inst_ord),
    {RANKS.replace("from fv", "from sv")}, {pearson('rk', 'rv', 'rf', 'ric')}
    select factor_id, round(abs(avg(ic)), 6) as control from ric group by 1""",
)
def _(spark, sf_dir):
    return robustness.asset_mismatch(values(spark, sf_dir)).select("factor_id", r6("control").alias("control"))


_NW = ", ".join(f"d * lag(d, {k}) over (partition by factor_id order by date_idx) l{k}" for k in range(1, HORIZON + 1))
_NWS = " + ".join(f"2 * (1 - {k} / {HORIZON + 1}.0) * sum(l{k})" for k in range(1, HORIZON + 1))


@query(
    "newey_west_t",
    f"""with {RANK_IC}, c as (select *, ic - avg(ic) over (partition by factor_id) d from ric where ic is not null), l as (select *, {_NW} from c)
    select factor_id, round(avg(ic) / sqrt(greatest((sum(d * d) + {_NWS}) / count(*), 1e-18) / count(*)), 6) as t, count(*) as n from l group by 1""",
)
def _(spark, sf_dir):
    return robustness.newey_west_t(metrics.daily_rank_ic(values(spark, sf_dir)), HORIZON).select("factor_id", r6("t").alias("t"), "n")


def _horner(powers: tuple[float, ...], x: str) -> str:
    return reduce(lambda sum_, c: f"({sum_} * {x} + {c!r}::double)", powers[1:], f"{powers[0]!r}::double")


_FAR = reduce(lambda below, k: f"(x + {k} / {below})", range(robustness.TAIL_TERMS, 0, -1), "(x + 0.65::double)")
#: p of a t: the upper normal tail, from columns t and x = abs(t)
TAIL_SQL = f"""case when t is null then 1.0 else (case when t >= 0 then tail else 1 - tail end) end"""
TAIL_CTE = f"""(select *, exp(-x * x / 2) * case when x < {robustness.TAIL_FROM!r} then {_horner(robustness.TAIL_OVER, "x")} / {_horner(robustness.TAIL_UNDER, "x")}
    else 1 / ({_FAR} * {robustness.ROOT_TWO_PI!r}::double) end tail from (select *, abs(t) x from nw))"""
NEWEY_WEST = """nw0 as (select factor_id, list(ic - m order by date_idx) d, any_value(m) m, count(*) n, least(floor(4 * pow(count(*) / 100.0::double, 2 / 9.0::double))::int, count(*) - 1)::int l
    from (select *, avg(ic) over (partition by factor_id) m from ric where ic is not null) group by 1),
nw as (select factor_id, n, case when n >= 3 then m / sqrt(greatest((list_inner_product(d, d) + coalesce(list_sum(list_transform(range(1, l + 1),
    lambda k: 2 * (1 - k / (l + 1.0::double)) * list_inner_product(d[1:n - k], d[k + 1:n]))), 0)) / n, 1e-18) / n) end t from nw0)"""


@query("newey_west_p", f"with {RANK_IC}, {NEWEY_WEST} select factor_id, round(t, 6) as t, round({TAIL_SQL}, 9) as p, n from {TAIL_CTE}")
def _(spark, sf_dir):
    """Each series with as many lags as its length asks for."""
    out = robustness.newey_west(metrics.daily_rank_ic(values(spark, sf_dir)))
    return out.select("factor_id", r6("t").alias("t"), r6("p", 9).alias("p"), "n")


@query(
    "recon_r2",
    f"""with {VALUES}, {RANKS}, s as (select floor(count(*) * 0.6)::int s from dates),
    c as (select a.date_idx, a.rv - 0.5 y, coalesce(b.rv - 0.5, 0) x from rk a join rk b using (date, instrument) where a.factor_id = 'f' and b.factor_id = 'g' and a.rv is not null),
    b as (select sum(x * y) / (sum(x * x) + 1e-4) beta from c, s where date_idx < s)
    select 'f' as factor_id, round(1 - sum((y - beta * x) ** 2) / (var_pop(y) * count(*)), 6) as r2 from c, s, b where date_idx >= s""",
)
def _(spark, sf_dir):
    v = values(spark, sf_dir)
    r2 = robustness.reconstruction_r2(v, "f", ["g"])
    return v.limit(0).agg(F.lit("f").alias("factor_id"), r6(F.lit(r2).cast("double")).alias("r2"))


# ---------------------------------------------------------------- universe, industry, neutralisation

SNAPSHOTS = """q0 as (select instrument, date_trunc('quarter', date)::date q, sum(volume) v from bars group by all),
snap as (select (q + interval 3 month)::date date, instrument from (select *, row_number() over (partition by q order by v desc, instrument) rn, count(*) over (partition by q) n from q0) where rn <= n / 2.0)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members after each quarter: the half of its suppliers with most volume."""
    q = P.supplier_months(spark, sf_dir).groupBy("instrument", F.to_date(F.date_trunc("quarter", "date")).alias("q")).agg(F.sum("volume").alias("v"))
    of = Window.partitionBy("q")
    place, n = F.row_number().over(of.orderBy(F.desc("v"), "instrument")), F.count("*").over(of)
    return q.withColumn("in", place <= n / 2).where("in").select(F.add_months("q", 3).alias("date"), "instrument")


@query(
    "universe_asof",
    f"""with {SM}, {SNAPSHOTS}, tk as (select d.date, max(s.date) taken from dates d left join (select distinct date from snap) s on s.date <= d.date group by 1)
    select p.date, p.instrument, s.instrument is not null as in_universe from panel p join tk using (date) left join snap s on s.date = tk.taken and s.instrument = p.instrument""",
)
def _(spark, sf_dir):
    return P.universe_asof(P.supplier_panel(spark, sf_dir), snapshots(spark, sf_dir)).select("date", "instrument", "in_universe")


INDUSTRY = """iv as (select s_suppkey::varchar instrument, n_regionkey::varchar industry, date '1990-01-01' in_date, date '1998-01-01' out_date, 0 seq from supplier join nation on s_nationkey = n_nationkey
    union all select s_suppkey::varchar, ((n_regionkey + 1) % 5)::varchar, date '1998-01-01', null, 1 from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 <> 0),
ind as (select date, instrument, arg_max(industry, row(in_date, seq)) industry from panel join iv using (instrument) where in_date <= date and (out_date is null or date < out_date) group by all)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as industries, moved on by one in 1998 for two suppliers of three; the rest have none from then."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")), F.col("s_nationkey") == F.col("n_nationkey"))
    day = lambda d: F.lit(d).cast("date")
    name = F.col("s_suppkey").cast("string").alias("instrument")
    before = s.select(name, F.col("n_regionkey").cast("string").alias("industry"), day("1990-01-01").alias("in_date"), day("1998-01-01").alias("out_date"), F.lit(0).alias("seq"))
    after = s.where("s_suppkey % 3 <> 0").select(name, ((F.col("n_regionkey") + 1) % 5).cast("string").alias("industry"), day("1998-01-01").alias("in_date"), day(None).alias("out_date"), F.lit(1).alias("seq"))
    return before.unionByName(after)


@query("industry_interval", f"with {SM}, {INDUSTRY} select p.date, p.instrument, industry from panel p left join ind using (date, instrument)")
def _(spark, sf_dir):
    return P.industry_on(P.supplier_panel(spark, sf_dir), intervals(spark, sf_dir)).select("date", "instrument", "industry")


@query(
    "industry_load",
    f"""with {INDUSTRY.split("ind as")[0].rstrip().rstrip(",")} select count(*) as rows, min(strftime(in_date, '%Y%m%d')) as earliest, count(*) filter (out_date is null) as open_intervals,
    count(*) filter (in_date <= date '1998-01-02' and (out_date is null or out_date > date '1998-01-02')) as members from iv""",
)
def _(spark, sf_dir):
    """Memberships written by industry, and the counts that the writing job took."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyyMMdd"), F.lit(""))
    rows = intervals(spark, sf_dir).select(F.col("instrument").alias("ts_code"), F.col("industry").alias("l1_code"), day("in_date").alias("in_date"), day("out_date").alias("out_date"))
    seen = industry.write_memberships(rows, f"{shared_folder(spark)}/industry-{uuid.uuid4().hex}", "19980102")
    return spark.createDataFrame([(seen.rows, seen.earliest, seen.open_intervals, seen.members)], "rows long, earliest string, open_intervals long, members long")


def exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with industry and size."""
    p = P.industry_on(with_forward(P.supplier_panel(spark, sf_dir)), intervals(spark, sf_dir)).withColumn("log_mv", F.ln("volume"))
    return factor_values(p, {"f": SIGNAL, "g": REVERSAL}, ("fwd", "industry", "log_mv"))


EXPOSED = f"""{VALUES}, {INDUSTRY}, ex as (select fv.*, coalesce(industry, 'UNK') industry, ln(volume) log_mv from fv join panel using (date, instrument)
    left join ind using (date, instrument))"""


@query("industry_demean", f"with {EXPOSED} select factor_id, date, instrument, round(value - avg(value) over (partition by factor_id, date, industry), 6) as \"value\" from ex")
def _(spark, sf_dir):
    return neutralize.industry_demean(exposed(spark, sf_dir)).select("factor_id", "date", "instrument", r6("value").alias("value"))


@query(
    "neutralize",
    f"""with {EXPOSED}, e1 as (select *, value - avg(value) over g v, log_mv0 - avg(log_mv0) over g x0
        from (select *, case when value is not null then log_mv end log_mv0 from ex) window g as (partition by factor_id, date, industry)),
    e2 as (select *, coalesce(x0, 0) x from e1),
    e3 as (select *, coalesce(sum(x * v) over d / nullif(sum(case when v is not null then x * x end) over d, 0), 0) beta from e2 window d as (partition by factor_id, date))
    select factor_id, date, instrument, round(v - beta * x, 6) as "value" from e3""",
)
def _(spark, sf_dir):
    return neutralize.neutralize(exposed(spark, sf_dir)).select("factor_id", "date", "instrument", r6("value").alias("value"))


@query(
    "liquidity_topn",
    f"""with {SM_BARS}, c as (select count(distinct date) n from bars)
    select instrument, round(avg(vwap * volume), 2) as amount, count(*) as days from bars, c group by instrument, n having count(*) >= floor(0.8 * n)
    order by avg(vwap * volume) desc, instrument limit 50""",
)
def _(spark, sf_dir):
    prices = P.supplier_months(spark, sf_dir).withColumn("amount", F.col("vwap") * F.col("volume"))
    return P.most_liquid(prices, 50).select("instrument", F.round("amount", 2).alias("amount"), "days")


# ---------------------------------------------------------------- the zoo

#: members by shape of formula, with the metrics they have on the panel
MEMBERS = ("reversal", "pressure", "price_volume", "calm", "range_place", "volume_noise", "low_rank", "heavy_reversal")


def shape_values(spark: SparkSession, sf_dir: str, shapes: tuple[str, ...], panel: DataFrame | None = None) -> DataFrame:
    trees = {s: formula_of(s).tree(formula_of(s).arguments[0]) for s in shapes}
    return factor_values(with_forward(panel or P.supplier_panel(spark, sf_dir)), trees, ("fwd", "ret1"))


def member_values(spark: SparkSession, sf_dir: str, shapes: tuple[str, ...] = MEMBERS, panel: DataFrame | None = None) -> DataFrame:
    # kept, as every metric reads it again
    return metrics.dealt(shape_values(spark, sf_dir, shapes, panel)).persist()


def member_metrics(v: DataFrame) -> DataFrame:
    """seq, factor_id and metrics of ``member_values``, rounded so that both engines compare the same numbers."""
    m = metrics.mean_and_ir(metrics.daily_rank_ic(v), mean="rank_ic", ir="rank_ir").join(metrics.coverage(v), "factor_id")
    m = m.join(metrics.daily_turnover(v), "factor_id", "left").join(longshort.quantile_spread(longshort.quantile_means(v)).withColumnRenamed("spread", "q_spread"), "factor_id", "left")
    seq = F.element_at(F.create_map(*(x for i, s in enumerate(MEMBERS) for x in (F.lit(s), F.lit(i)))), F.col("factor_id"))
    rounded = [r6(c).alias(c) for c in ("rank_ic", "rank_ir", "coverage", "turnover", "q_spread")]
    unknown = [F.lit(None).cast("double").alias(c) for c in zoo.METRICS if c not in ("rank_ic", "rank_ir", "coverage", "turnover", "q_spread")]
    return m.select(seq.alias("seq"), "factor_id", *rounded, *unknown)


def tree_sql(tree: Node) -> tuple[str, str]:
    """CTEs over ``panel`` (names n1, n2, ...) that add the tree's nodes as columns, and the last column."""
    made: dict[Node, str] = {}
    ctes: list[str] = []

    def build(n: Node) -> str:
        if n.op is None:
            return f'"{n.name}"'
        if n in made:
            return made[n]
        x = [build(c) for c in n.children]
        t = n.params[0] if n.params else 0
        if n.op.name == "Autocorr":
            x.append(build(Node(next(o for o in operators() if o.name == "Delay"), "Delay", n.children, n.params[1:])))
        forms = {
            "Neg": lambda: f"-{x[0]}", "Sub": lambda: f"{x[0]} - {x[1]}", "Mul": lambda: f"{x[0]} * {x[1]}", "Div": lambda: f"{x[0]} / nullif({x[1]}, 0)",
            "Delay": lambda: f"lag({x[0]}, {t}) over {W}", "Diff": lambda: f"{x[0]} - lag({x[0]}, {t}) over {W}", "Pct": lambda: f"{x[0]} / nullif(lag({x[0]}, {t}) over {W}, 0) - 1",
            "Ma": lambda: full(x[0], t, f"avg({x[0]}) over {win(t)}"), "Std": lambda: full(x[0], t, f"stddev_samp({x[0]}) over {win(t)}"),
            "Max": lambda: full(x[0], t, f"max({x[0]}) over {win(t)}"), "Min": lambda: full(x[0], t, f"min({x[0]}) over {win(t)}"),
            "Zscore": lambda: full(x[0], t, f"({x[0]} - avg({x[0]}) over {win(t)}) / nullif(stddev_samp({x[0]}) over {win(t)}, 0)"),
            "Vari": lambda: full(x[0], t, f"stddev_samp({x[0]}) over {win(t)} / nullif(avg({x[0]}) over {win(t)}, 0)"),
            "Rank": lambda: full(x[0], t, f"(len(list_filter(list({x[0]}) over {win(t)}, lambda v: v < {x[0]})) + (len(list_filter(list({x[0]}) over {win(t)}, lambda v: v = {x[0]})) + 1) / 2.0) / {t}"),
            "Skew": lambda: _moment("skewness", t, "0.0").replace("ret", x[0]), "Corr": lambda: _corr(x[0], x[1], t), "Autocorr": lambda: _corr(x[0], x[1], t),
        }
        sql = forms[n.op.name]()
        made[n] = name = f"v{len(made)}"
        ctes.append(f"n{len(ctes) + 1} as (select *, {sql if sql.startswith('(case') else fin(sql)} {name} from {f'n{len(ctes)}' if ctes else 'panel'})")
        return name

    last = build(tree)
    return ", ".join(ctes), last


def _renamed(ctes: str, last: str, tag: str) -> tuple[str, str, str]:
    """The CTEs under names of their own: (CTEs, last CTE, last column)."""
    n = ctes.count(" as (select *, ")
    for i in range(n, 0, -1):
        ctes = ctes.replace(f"n{i} as (", f"{tag}{i} as (").replace(f"from n{i})", f"from {tag}{i})")
    return ctes, f"{tag}{n}", last


def member_sql(shapes: tuple[str, ...] = MEMBERS) -> str:
    """CTE fv of the members' values, as VALUES has it."""
    parts, unions = [], []
    for i, s in enumerate(shapes):
        f = formula_of(s)
        ctes, at, last = _renamed(*tree_sql(f.tree(f.arguments[0])), f"z{i}_")
        parts.append(ctes)
        unions.append(f"select '{s}' factor_id, date, date_idx, instrument, inst_ord, {last} \"value\", fwd, ret1 from {at}")
    forward = f"""panel as (select *, {fin(f'lead("close", {HORIZON}) over {W} / nullif("close", 0) - 1')} fwd,
    {fin(f'lead("close", 1) over {W} / nullif("close", 0) - 1')} ret1 from panel0)"""
    return f"{SM.replace('panel as (', 'panel0 as (')}, {forward}, {', '.join(parts)}, fv as ({' union all '.join(unions)})"


for _shape in TEMPLATES:
    _f = formula_of(_shape)
    _tree = _f.tree(_f.arguments[0])
    _ctes, _last = tree_sql(_tree)
    _n = _ctes.count(" as (select *, ")
    query(f"template_{_shape}", f'with {SM}, {_ctes} select date, instrument, round({_last}, 6) as "value" from n{_n}')(_op_query(_tree))

_SEQ = "case factor_id " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(MEMBERS)) + " end"
ZOO = f"""{member_sql()}, {RANKS}, {pearson('rk', 'rv', 'rf', 'ric')},
z1 as (select factor_id, round(avg(ic), 6) rank_ic, round(case when stddev_samp(ic) > 1e-12 then avg(ic) / stddev_samp(ic) end, 6) rank_ir from ric group by 1),
z2 as (select factor_id, round(count(value) / count(*)::double, 6) coverage from fv group by 1),
{TOP.split(VALUES + ", ")[1]}, a as (select *, sum(weight) over (partition by factor_id, date) > 0 active from tw),
m as (select factor_id, date, abs(weight - lag(weight) over (partition by factor_id, instrument order by date_idx)) d from a where active),
y as (select factor_id, date, sum(d) t from m group by all), z3 as (select factor_id, round(avg(t), 6) turnover from y group by 1),
{MEANS.split(VALUES + ", ")[1]},
z4 as (select factor_id, round(max(case when bucket = 5 then mean_return end) - max(case when bucket = 1 then mean_return end), 6) q_spread from bm group by 1),
zoo as (select {_SEQ} seq, * from z1 join z2 using (factor_id) left join z3 using (factor_id) left join z4 using (factor_id))"""


@query("zoo_metrics", f"with {ZOO} select seq, factor_id, rank_ic, rank_ir, coverage, turnover, q_spread from zoo")
def _(spark, sf_dir):
    return member_metrics(member_values(spark, sf_dir)).select("seq", "factor_id", "rank_ic", "rank_ir", "coverage", "turnover", "q_spread")


@query(
    "relative_rank",
    f"""with {ZOO} select factor_id, round(coalesce((select count(*) from zoo o where o.rank_ic > zoo.rank_ic), 0) / (select count(*) from zoo)::double, 6) as rel_rank_ic,
    round(coalesce((select count(*) from zoo o where o.turnover < zoo.turnover), 0) / (select count(*) from zoo)::double, 6) as rel_turnover from zoo""",
)
def _(spark, sf_dir):
    z = member_metrics(member_values(spark, sf_dir))
    both = zoo.relative_rank(zoo.relative_rank(z, z, "rank_ic"), z, "turnover", higher=False)
    return both.select("factor_id", r6("rel_rank_ic").alias("rel_rank_ic"), r6("rel_turnover").alias("rel_turnover"))


@query(
    "admission_gates",
    f"""with {ZOO}, r as (select *, (select count(*) from zoo o where o.rank_ic > zoo.rank_ic) / (select count(*) from zoo)::double ra,
    (select count(*) from zoo o where o.rank_ir > zoo.rank_ir) / (select count(*) from zoo)::double rb from zoo)
    select factor_id, concat_ws(',', case when not coalesce(rank_ic >= 0.015, false) then 'rank_ic' end, case when not coalesce(rank_ir >= 0.3, false) then 'rank_ir' end,
    case when turnover > 1.6 then 'turnover' end, case when ra > 0.95 then 'rel_rank_ic' end, case when rb > 0.95 then 'rel_rank_ir' end, case when q_spread <= 0 then 'spread' end) as reasons from r""",
)
def _(spark, sf_dir):
    z = member_metrics(member_values(spark, sf_dir))
    return zoo.admission(z, z).select("factor_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("top_by_rank_ir", f"with {ZOO} select factor_id, rank_ir from zoo order by rank_ir desc nulls last, seq limit 5")
def _(spark, sf_dir):
    return zoo.top_by_rank_ir(member_metrics(member_values(spark, sf_dir)), 5).select("factor_id", "rank_ir")


@query(
    "exemplars",
    f"""with {ZOO}, pr as (select b.factor_id, a.date, a.date_idx, a.rv x0, b.rv y0 from rk a join rk b using (date, instrument) where a.factor_id = 'reversal' and b.factor_id <> 'reversal'),
    {pearson('pr', 'x0', 'y0', 'fc')}, c as (select factor_id, coalesce(round(abs(avg(ic)), 6), 0) c from fc group by 1),
    o as (select zoo.*, c, row_number() over (order by c desc, seq) rn, count(*) over () n from zoo join c using (factor_id))
    select factor_id, rank_ic from o where rn > floor(n * 0.5) order by case when rank_ic <> 0 then rank_ic end desc nulls last, c desc, seq limit 2""",
)
def _(spark, sf_dir):
    v = member_values(spark, sf_dir)
    pairs = v.select(F.col("factor_id").alias("b")).distinct().where("b <> 'reversal'").withColumn("a", F.lit("reversal"))
    corr = metrics.factor_correlation(v, pairs).select("other_id", r6("corr").alias("corr"))
    members = member_metrics(v).where("factor_id <> 'reversal'")
    return zoo.exemplars(members, "effectiveness", corr, k=2).select("factor_id", "rank_ic")


# ---------------------------------------------------------------- the zoo, member after member

#: Three shapes whose likeness SQL can express: each is regressed on two others at most
TRIO = ("pressure", "price_volume", "range_place")
#: Gates that are open but for likeness; and thresholds for monthly panels, on which some of every gate's candidates fail
ALIKE_ONLY = zoo.Criteria(min_rank_ic=-1.0, min_rank_ir=-1e9, max_rel_rank=1.01, max_correlation=0.3, max_recon_r2=0.1)
MONTHLY = zoo.Criteria(min_rank_ic=0.0, min_rank_ir=0.05, max_turnover=1.5, max_correlation=0.3, max_rel_rank=0.5, max_control_ic=0.01, max_recon_r2=0.1, min_q_monotonic=0.6, min_ls_sharpe=0.5, require_valid_sign=True)
BLOCK_LEAST, YEAR_LEAST = 10, 5


def trio_likeness(train: bool) -> str:
    """CTEs cc (pair, c: mean daily rank correlation) and r2 (one row: r2_<of>_<pool>, by places in TRIO) over rk.

    ``train``: dates are those of the training part, s0.n of them.
    """
    dates = "(select n from s0)" if train else "(select count(*) from dates)"
    wide = ", ".join(f"max(case when factor_id = '{f}' then rv - 0.5 end) x{i}" for i, f in enumerate(TRIO))
    parts, names = [], []
    for y in range(3):
        for pool in ([a for a in range(3) if a != y], *([a] for a in range(3) if a != y)):
            tag = f"{y}_{''.join(map(str, pool))}"
            x = [f"coalesce(x{a}, 0)" for a in pool]
            sums = [f"sum({u} * {v}) g{i}{j}" for i, u in enumerate(x) for j, v in enumerate(x)] + [f"sum(x{y} * {u}) b{i}" for i, u in enumerate(x)]
            parts.append(f"m{tag} as (select count(*) n, {', '.join(sums)} from w3, sp3 where x{y} is not null and date_idx < s)")
            if len(pool) == 1:
                beta = "select n, b0 / (g00 + 1e-4) k0"
            else:
                det = "((g00 + 1e-4) * (g11 + 1e-4) - g01 * g10)"
                beta = f"select n, ((g11 + 1e-4) * b0 - g01 * b1) / {det} k0, ((g00 + 1e-4) * b1 - g10 * b0) / {det} k1"
            fitted = " - ".join(f"k{i} * {u}" for i, u in enumerate(x))
            parts.append(f"""q{tag} as (select case when any_value(n) >= 100 and count(*) >= 100 then 1 - sum((x{y} - {fitted}) ** 2) / (var_pop(x{y}) * count(*)) end r2_{tag}
                from w3, sp3, ({beta} from m{tag}) where x{y} is not null and date_idx >= s)""")
            names.append(f"q{tag}")
    return f"""pr as (select a.factor_id || '|' || b.factor_id factor_id, a.date, a.date_idx, a.rv x0, b.rv y0 from rk a join rk b using (date, instrument) where a.factor_id < b.factor_id),
{pearson('pr', 'x0', 'y0', 'fc')}, cc as (select factor_id pair, abs(avg(ic)) c from fc group by 1),
w3 as (select date_idx, instrument, {wide} from rk group by all), sp3 as (select floor({dates} * 0.6)::int s),
{', '.join(parts)}, r2 as (select * from {', '.join(names)})"""


def _pair(a: int, b: int) -> str:
    return f"(select c from cc where pair = '{'|'.join(sorted((TRIO[a], TRIO[b])))}')"


ADMISSION_ORDER = f"""{member_sql(TRIO)}, {RANKS}, {trio_likeness(False)},
a1 as (select {_pair(0, 1)} c1, r2_1_0 r1, not ({_pair(0, 1)} >= {ALIKE_ONLY.max_correlation} or coalesce(r2_1_0 > {ALIKE_ONLY.max_recon_r2}, false)) in1, * from r2),
a2 as (select *, case when in1 then greatest({_pair(0, 2)}, {_pair(1, 2)}) else {_pair(0, 2)} end c2, case when in1 then r2_2_01 else r2_2_0 end r2 from a1)"""


@query(
    "admission_order",
    f"""with {ADMISSION_ORDER} select '{TRIO[0]}' as factor_id, 0 as place, 0.0 as max_corr, null::double as recon_r2
    union all select '{TRIO[1]}', case when in1 then 1 else -1 end, round(c1, 6), round(r1, 6) from a2
    union all select '{TRIO[2]}', case when not (c2 >= {ALIKE_ONLY.max_correlation} or coalesce(r2 > {ALIKE_ONLY.max_recon_r2}, false)) then 1 + in1::int else -1 end, round(c2, 6), round(r2, 6) from a2""",
)
def _(spark, sf_dir):
    """Who of three gets in, one after the other, each measured against those who are in: their places (-1: not in), from one job for their likeness."""
    v = member_values(spark, sf_dir, TRIO)
    likeness, found, rows = gram(v, TRIO), zoo.Zoo(ALIKE_ONLY), []
    v.unpersist()
    for name in TRIO:
        m = zoo.Member(name, name, {}, {}, {"rank_ic": 0.0, "rank_ir": 0.0})
        place = -1 if found.offer(m, likeness) else len(found.members) - 1
        rows.append((name, place, m.metrics["max_corr"], m.metrics["recon_r2"]))
    out = spark.createDataFrame(rows, "factor_id string, place int, max_corr double, recon_r2 double")
    return out.select("factor_id", "place", r6("max_corr").alias("max_corr"), r6("recon_r2").alias("recon_r2"))


def training(panel: DataFrame) -> search.Split:
    return search.Split.at(panel.agg(F.max("date_idx") + 1).first()[0])


def trio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, factor_id and all 18 metrics of the trio on the training and validation dates; likeness is to the two others."""
    panel = P.supplier_panel(spark, sf_dir)
    v, split = member_values(spark, sf_dir, TRIO, panel), training(panel)
    likeness = gram(search.within(v, split.train), TRIO, dates=split.train)
    others = {f: [o for o in TRIO if o != f] for f in TRIO}
    alike = spark.createDataFrame([(i, f, likeness.max_corr(f, others[f]), likeness.recon_r2(f, others[f])) for i, f in enumerate(TRIO)], "seq int, factor_id string, max_corr double, recon_r2 double")
    rows = search.full_metrics(v, split, HORIZON, BLOCK_LEAST, YEAR_LEAST).join(alike, "factor_id")
    return rows.select("seq", "factor_id", *(r6(m).alias(m) for m in zoo.METRICS))


_LAST = RANKS.replace("from fv", "from fva").replace("rk as", "rkv as")
TRIO_METRICS = f"""{member_sql(TRIO).replace("fv as (", "fvx as (")}, {SPLIT}, s0 as (select s + 1 n from sp),
fv as (select fvx.* from fvx, sp where date_idx <= s), fva as (select fvx.* from fvx, sp where date_idx > s),
{RANKS}, {pearson('rk', 'rv', 'rf', 'ric')}, {pearson('fv', 'value', 'fwd', 'oic')}, {_LAST}, {pearson('rkv', 'rv', 'rf', 'vic')},
{TOP.split(VALUES + ", ")[1]}, ac as (select *, sum(weight) over (partition by factor_id, date) > 0 active from tw),
mv as (select factor_id, date, abs(weight - lag(weight) over (partition by factor_id, instrument order by date_idx)) d from ac where active),
tu as (select factor_id, avg(t) turnover from (select factor_id, date, sum(d) t from mv group by all) group by 1),
{MEANS.split(VALUES + ", ")[1]}, {LS.split(BUCKETS + ", ")[1]}, {MONO}, {SHARPE},
nb as (select *, ntile(4) over (partition by factor_id order by date_idx) block from ric where ic is not null),
bf as (select factor_id, case when sum(n) >= {4 * BLOCK_LEAST} then avg((m > 0)::int::double) end block_pos_frac from (select factor_id, block, avg(ic) m, count(*) n from nb group by all) group by 1),
yf as (select factor_id, avg((m > 0)::int::double) year_pos_frac from (select factor_id, year(date) y, avg(ic) m from ric where ic is not null group by all having count(*) >= {YEAR_LEAST}) group by 1),
nn as (select count(*) n from names), sv as (select a.factor_id, a.date, a.date_idx, a.instrument, a.inst_ord, b.value "value", a.fwd from fv a, nn
    join fv b on b.factor_id = a.factor_id and b.date = a.date and (b.inst_ord + 1) % n = a.inst_ord),
{RANKS.replace("from fv", "from sv").replace("rk as", "rks as")}, {pearson('rks', 'rv', 'rf', 'sic')},
c0 as (select *, ic - avg(ic) over (partition by factor_id) d from ric where ic is not null), l0w as (select *, {_NW} from c0),
nw as (select factor_id, count(*) n, case when count(*) >= 3 then avg(ic) / sqrt(greatest((sum(d * d) + {_NWS}) / count(*), 1e-18) / count(*)) end t from l0w group by 1),
hp as (select factor_id, t hac_t, {TAIL_SQL} hac_p from {TAIL_CTE}), {trio_likeness(True)},
tm as (select case factor_id {' '.join(f"when '{f}' then {i}" for i, f in enumerate(TRIO))} end seq, factor_id,
    (select avg(ic) from oic where oic.factor_id = f.factor_id) ic, (select case when stddev_samp(ic) > 1e-12 then avg(ic) / stddev_samp(ic) end from oic where oic.factor_id = f.factor_id) ic_ir,
    (select avg(ic) from ric where ric.factor_id = f.factor_id) rank_ic, (select case when stddev_samp(ic) > 1e-12 then avg(ic) / stddev_samp(ic) end from ric where ric.factor_id = f.factor_id) rank_ir,
    turnover, (select count(value) / count(*)::double from fv where fv.factor_id = f.factor_id) coverage,
    case factor_id {' '.join(f"when '{f}' then greatest({', '.join(_pair(i, j) for j in range(3) if j != i)})" for i, f in enumerate(TRIO))} end max_corr,
    hac_t, hac_p, block_pos_frac, year_pos_frac, (select abs(avg(ic)) from sic where sic.factor_id = f.factor_id) control_ic,
    case factor_id {' '.join(f"when '{f}' then (select r2_{i}_{''.join(str(j) for j in range(3) if j != i)} from r2)" for i, f in enumerate(TRIO))} end recon_r2,
    (select max(case when bucket = 5 then mean_return end) - max(case when bucket = 1 then mean_return end) from bm where bm.factor_id = f.factor_id) q_spread,
    monotonic q_monotonic, sharpe ls_sharpe, (select avg(ic) from vic where vic.factor_id = f.factor_id) rank_ic_valid,
    (select case when stddev_samp(ic) > 1e-12 then avg(ic) / stddev_samp(ic) end from vic where vic.factor_id = f.factor_id) rank_ir_valid
    from (select distinct factor_id from fv) f left join tu using (factor_id) left join mono using (factor_id) left join sh using (factor_id)
    left join bf using (factor_id) left join yf using (factor_id) left join hp using (factor_id)),
tr as (select seq, factor_id, {', '.join(f"round({m}, 6) {m}" for m in zoo.METRICS)} from tm)"""


@query("full_metrics", f"with {TRIO_METRICS} select * from tr")
def _(spark, sf_dir):
    return trio_metrics(spark, sf_dir)


_TESTS = {operator.lt: "<", operator.le: "<=", operator.gt: ">", operator.ge: ">="}
_GATES = ", ".join(
    f"case when {f'coalesce({m} {_TESTS[fails]} {getattr(MONTHLY, limit)}, true)' if m in zoo.REQUIRED else f'{m} {_TESTS[fails]} {getattr(MONTHLY, limit)}'} then '{name}' end"
    for name, m, fails, limit in zoo.GATES
)


@query(
    "admission_gates_full",
    f"""with {TRIO_METRICS}, gr as (select *, (select count(*) from tr o where o.rank_ic > tr.rank_ic) / 3.0::double rel_rank_ic,
    (select count(*) from tr o where o.rank_ir > tr.rank_ir) / 3.0::double rel_rank_ir from tr)
    select factor_id, concat_ws(',', {_GATES}, case when rank_ic * rank_ic_valid <= 0 then 'sign' end) as reasons from gr""",
)
def _(spark, sf_dir):
    """All 15 gates, with every metric they look at."""
    m = trio_metrics(spark, sf_dir).persist()
    return zoo.admission(m, m, MONTHLY).select("factor_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("rescreen")
def _(spark, sf_dir):
    """Admission of the members played again under stricter gates, in their order: place in the new zoo, or -1 and the reasons against it."""
    grid = P.supplier_panel(spark, sf_dir)
    panel, split = with_forward(grid), training(grid)
    formulas = {s: formula_of(s) for s in MEMBERS}
    old = zoo.Zoo(members=[zoo.Member(s, f.text(f.arguments[0]), f.to_json(), f.arguments[0], {"rank_ic": 0.0, "rank_ir": 0.0}) for s, f in formulas.items()])
    fresh, told = search.rescreen(panel, old, HORIZON, split, RESCREENED, block_least=BLOCK_LEAST, year_least=YEAR_LEAST)
    place = {m.expression: i for i, m in enumerate(fresh.members)}
    rows = [(i, e, place.get(e, -1), ",".join(reasons)) for i, (e, reasons) in enumerate(told)]
    return spark.createDataFrame(rows, "seq int, expression string, place int, reasons string")


#: Gates of the re-screening: robustness and likeness
RESCREENED = zoo.Criteria(min_rank_ic=-1.0, min_rank_ir=-1e9, max_hac_pvalue=0.9, min_block_frac=0.25, min_year_frac=0.2, max_control_ic=0.05, max_correlation=0.5, max_recon_r2=0.5, min_q_spread=-1.0, min_ls_sharpe=-9.0)


@query("fsa_closed")
def _(spark, sf_dir):
    """Frequent closed subtrees of the members that have values on most of the panel."""
    used = {r.factor_id for r in metrics.coverage(member_values(spark, sf_dir, tuple(TEMPLATES))).where("coverage > 0.5").collect()}
    trees = [formula_of(s).tree() for s in TEMPLATES if s in used]
    return closed_genes(gene_table(spark, trees), len(trees), top_k=5, least_support=0.15)


# ---------------------------------------------------------------- combination and backtests

BASKET = ("pressure", "price_volume", "range_place")
HALFLIFE, WARM_UP = 12.0, 12


def basket(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """Ranks of the basket's factors, dealt by date and kept so, as weights and combinations read them again."""
    return combine.rank_normalized(metrics.dealt(shape_values(spark, sf_dir, BASKET, panel), "date")).persist()


BASKET_SQL = f"{member_sql(BASKET)}, rk0 as (select *, {ranked('value', 'rv0')} from fv), ft as (select * exclude (value, rv0), coalesce(rv0 - 0.5, 0) \"value\" from rk0)"
EQUAL = f"{BASKET_SQL}, pr as (select date, date_idx, instrument, inst_ord, avg(value) pred from ft group by all)"
EWMA = f"""{BASKET_SQL}, {RANKS.replace("from fv", "from ft")}, {pearson('rk', 'rv', 'rf', 'ric')},
e0 as (select f.factor_id, f.date, f.date_idx, ic, pow(2, (f.date_idx - max(f.date_idx) over ()) / {HALFLIFE}) g from (select distinct factor_id, date, date_idx from ft) f left join ric using (factor_id, date)),
e1 as (select *, case when count(ic) over u >= {WARM_UP} then sum(ic * g) over u / nullif(sum(case when ic is not null then g end) over u, 0) end s
    from e0 window u as (partition by factor_id order by date_idx rows between unbounded preceding and current row)),
e2 as (select *, lag(s, {HORIZON + 1}) over (partition by factor_id order by date_idx) l from e1),
e3 as (select factor_id, date, date_idx, case when l is not null then greatest(l, 0) end s from e2),
ew as (select factor_id, date, date_idx, coalesce(case when sum(s) over d > 0 then s / sum(s) over d end, 1 / (count(*) over d)::double) weight from e3 window d as (partition by date))"""


@query("combine_equal", f"with {EQUAL} select date, instrument, round(pred, 6) as pred from pr")
def _(spark, sf_dir):
    return combine.equal_weight(basket(spark, sf_dir)).select("date", "instrument", r6("pred").alias("pred"))


@query("ewma_weights", f"with {EWMA} select factor_id, date, round(weight, 6) as weight from ew")
def _(spark, sf_dir):
    return combine.ewma_weights(basket(spark, sf_dir), HALFLIFE, WARM_UP, HORIZON).select("factor_id", "date", r6("weight").alias("weight"))


@query("combine_ewma", f"with {EWMA} select date, instrument, round(sum(value * weight), 6) as pred from ft join ew using (factor_id, date) group by 1, 2")
def _(spark, sf_dir):
    b = basket(spark, sf_dir)
    return combine.weighted(b, combine.ewma_weights(b, HALFLIFE, WARM_UP, HORIZON)).select("date", "instrument", r6("pred").alias("pred"))


def market(panel: DataFrame) -> DataFrame:
    return panel.select("date", "date_idx", "instrument", P.daily_return().alias("ret")).withColumn("bench", F.col("ret"))


def traded(spark: SparkSession, sf_dir: str, panel: DataFrame) -> DataFrame:
    """Equal-weight predictions (to 9 places, so that ties are ties in any engine) where there is a close."""
    pred = combine.equal_weight(basket(spark, sf_dir, panel))
    close = panel.select("date_idx", "instrument", "close")
    return pred.join(close, ["date_idx", "instrument"]).select("date", "date_idx", "instrument", "inst_ord", F.when(F.col("close").isNotNull(), F.round("pred", 9)).alias("pred"))


def periodic_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and returns of one panel, worked out once each."""
    panel = P.supplier_panel(spark, sf_dir)
    return backtest.periodic(stored(traded(spark, sf_dir, panel)), stored(market(panel)), HORIZON)


PERIODIC = f"""{EQUAL}, {_FILL}, tr as (select pr.date, date_idx, instrument, pr.inst_ord, case when "close" is not null then round(pred, 9) end pred from pr join panel using (date_idx, instrument)),
bk as (select greatest(1, round_even(0.1 * floor(median(n)), 0))::int k from (select date_idx, count(pred) n from tr group by 1)),
tg as (select date_idx since, instrument from (select *, row_number() over (partition by date_idx order by pred desc, inst_ord) pos from tr where pred is not null and date_idx % {HORIZON} = 0), bk where pos <= k),
bs as (select since, count(*) size, lag(since) over (order by since) prev from tg group by since),
kp as (select bs.since, count(*) kept from bs join tg a on a.since = bs.since join tg b on b.since = bs.prev and b.instrument = a.instrument group by 1),
co as (select bs.since, case when bs.prev is null then 0.0015 else 0.0015 * 2.0 * (p.size - coalesce(kept, 0)) / bs.size end cost from bs left join kp using (since) left join bs p on p.since = bs.prev),
dn as (select d.date, d.date_idx, max(bs.since) since from dates d left join bs on bs.since < d.date_idx where d.date_idx > 0 group by all),
be as (select date_idx, coalesce(avg(ret), 0) bench from f1 group by 1),
po as (select dn.date_idx, avg(f1.ret) port from dn join tg using (since) join f1 on f1.date_idx = dn.date_idx and f1.instrument = tg.instrument group by 1),
xs as (select dn.date, dn.date_idx, case when dn.since is null then 0.0 else coalesce(port, bench) end - bench - coalesce(cost, 0) excess
    from dn join be using (date_idx) left join po using (date_idx) left join co on co.since + 1 = dn.date_idx)"""


@query("backtest_periodic", f"with {PERIODIC} select date, round(excess, 6) as excess from xs")
def _(spark, sf_dir):
    return periodic_excess(spark, sf_dir).select("date", r6("excess").alias("excess"))


@query("backtest_summary", f"with {PERIODIC} select count(*) as days, round(avg(excess) * 252, 5) as aer, round(avg(excess) * 252 / (stddev_samp(excess) * sqrt(252.0)), 5) as ir from xs")
def _(spark, sf_dir):
    s = backtest.summary(periodic_excess(spark, sf_dir))
    return s.select("days", F.round("aer", 5).alias("aer"), F.round("ir", 5).alias("ir"))


# ---------------------------------------------------------------- sizes, models and periods

SIZES, MODELS = (2, 3), ("equal", "ewma")


def grid_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier panel with industry, size, membership and forward returns."""
    p = P.industry_on(with_forward(P.supplier_panel(spark, sf_dir)), intervals(spark, sf_dir)).withColumn("log_mv", F.ln("volume"))
    return P.universe_asof(p, snapshots(spark, sf_dir))


def grid_periods(n: int) -> dict[str, tuple[int, int]]:
    a, b = P.split_at(n, 0.6), P.split_at(n, 0.8)
    return {"valid": (a + 1, b), "test": (b + 1, n - 1)}


_PLACE = "case factor_id " + " ".join(f"when '{f}' then {i}" for i, f in enumerate(BASKET)) + " end"
FEATURES = f"""{member_sql(BASKET).replace("fv as (", "fv0 as (")}, {SNAPSHOTS}, {INDUSTRY},
tk as (select d.date, max(s.date) taken from dates d left join (select distinct date from snap) s on s.date <= d.date group by 1),
un as (select p.date, p.instrument, s.instrument is not null member, "close" is not null traded from panel p join tk using (date) left join snap s on s.date = tk.taken and s.instrument = p.instrument),
ex as (select fv0.*, coalesce(industry, 'UNK') industry, ln(volume) log_mv, member from fv0 join panel using (date, instrument) left join ind using (date, instrument) join un using (date, instrument)),
e1n as (select *, value - avg(value) over g v, log_mv0 - avg(log_mv0) over g x0 from (select *, case when value is not null then log_mv end log_mv0 from ex) window g as (partition by factor_id, date, industry)),
e2n as (select *, coalesce(x0, 0) x from e1n),
e3n as (select *, coalesce(sum(x * v) over d / nullif(sum(case when v is not null then x * x end) over d, 0), 0) beta from e2n window d as (partition by factor_id, date)),
nv as (select factor_id, date, date_idx, instrument, inst_ord, case when member then v - beta * x end "value", case when member then fwd end fwd from e3n),
rk0 as (select *, {ranked('value', 'rv0')} from nv), ft as (select * exclude (value, rv0), coalesce(rv0 - 0.5, 0) "value" from rk0)"""
GRID = f"""{FEATURES}{EWMA.split(BASKET_SQL)[1]}, {_FILL}, sz as (select unnest({list(SIZES)}) size),
nd as (select greatest(least(floor(count(*) * 0.6)::int - 1, count(*) - 1), 0) a, greatest(least(floor(count(*) * 0.8)::int - 1, count(*) - 1), 0) b, count(*) n from dates),
per as (select 'valid' period, a + 1 since, b upto from nd union all select 'test', b + 1, n - 1 from nd),
pe as (select 'equal' model, size, date, date_idx, instrument, inst_ord, avg(value) pred from ft, sz where {_PLACE} < size group by all),
we as (select size, factor_id, date, s, sum(s) over (partition by size, date) tot, count(*) over (partition by size, date) n from e3, sz where {_PLACE} < size),
pw as (select 'ewma' model, size, date, date_idx, instrument, inst_ord, sum(value * coalesce(case when tot > 0 then s / tot end, 1 / n::double)) pred from ft join we using (factor_id, date) group by all),
pd as (select model || '|' || size || '|' || period factor_id, date, date_idx, instrument, inst_ord, case when member and traded then round(pred, 9) end "value", case when member then panel.fwd end fwd
    from (select * from pe union all select * from pw) join un using (date, instrument) join panel using (date, date_idx, instrument, inst_ord) join per on date_idx between since and upto),
{pearson('pd', 'value', 'fwd', 'pic')}, {RANKS.replace("from fv", "from pd").replace("rk as", "rkp as")}, {pearson('rkp', 'rv', 'rf', 'pri')},
ds as (select factor_id, date, date_idx, count(value) n from pd group by all),
bk as (select factor_id, greatest(1, round_even(0.1 * floor(median(n)), 0))::int k, min(date_idx) start from ds group by 1),
tg as (select factor_id, date_idx since, instrument from (select pd.*, k, row_number() over (partition by factor_id, date_idx order by value desc, inst_ord) pos from pd join bk using (factor_id)
    where value is not null and (date_idx - start) % {HORIZON} = 0) where pos <= k),
bs as (select factor_id, since, count(*) size, lag(since) over (partition by factor_id order by since) prev, lag(count(*)) over (partition by factor_id order by since) was from tg group by 1, 2),
kp as (select bs.factor_id, bs.since, count(*) kept from bs join tg a on a.factor_id = bs.factor_id and a.since = bs.since join tg b on b.factor_id = bs.factor_id and b.since = bs.prev and b.instrument = a.instrument group by all),
co as (select factor_id, since, case when prev is null then 0.0015 else 0.0015 * 2.0 * (was - coalesce(kept, 0)) / size end cost from bs left join kp using (factor_id, since)),
dn as (select ds.factor_id, ds.date, ds.date_idx, max(bs.since) since from ds join bk using (factor_id) left join bs on bs.factor_id = ds.factor_id and bs.since < ds.date_idx where ds.date_idx > start group by all),
be as (select f1.date_idx, coalesce(avg(case when member then ret end), 0) bench from f1 join un using (date, instrument) group by 1),
po as (select dn.factor_id, dn.date_idx, avg(f1.ret) port from dn join tg using (factor_id, since) join f1 on f1.date_idx = dn.date_idx and f1.instrument = tg.instrument group by all),
xs as (select dn.factor_id, case when dn.since is null then 0.0 else coalesce(port, bench) end - bench - coalesce(cost, 0) excess
    from dn join be using (date_idx) left join po using (factor_id, date_idx) left join co on co.factor_id = dn.factor_id and co.since + 1 = dn.date_idx)"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, tuple[int, int]]]:
    """Features, the panel and the periods of the grid; what all runs read is worked out once."""
    p = stored(grid_panel(spark, sf_dir))
    f = evaluation.features(p, {s: formula_of(s).tree(formula_of(s).arguments[0]) for s in BASKET}).persist()
    return f, p, grid_periods(p.agg(F.max("date_idx") + 1).first()[0])


@query(
    "evaluate_zoo",
    f"""with {GRID}, su as (select factor_id, count(*) as days, avg(excess) * 252 aer, avg(excess) * 252 / (stddev_samp(excess) * sqrt(252.0)) ir from xs group by 1)
    select split_part(factor_id, '|', 1) as model, split_part(factor_id, '|', 2)::int as size, split_part(factor_id, '|', 3) as period,
    round((select avg(ic) from pic where pic.factor_id = su.factor_id), 6) as ic, round((select avg(ic) from pri where pri.factor_id = su.factor_id), 6) as rank_ic,
    days, round(aer, 5) as aer, round(ir, 5) as ir from su""",
)
def _(spark, sf_dir):
    """Two sizes, two models and two periods, over neutralised features of members only, as runs of one plan."""
    f, p, periods = _grid(spark, sf_dir)
    pred = evaluation.combined(f, BASKET, SIZES, MODELS, periods["valid"][0] - 1, HORIZON, HALFLIFE, WARM_UP)
    returns = stored(evaluation.market(p.withColumn("ret", P.daily_return())))
    out = evaluation.evaluate(pred, returns, periods, HORIZON, "periodic")
    return out.select("model", "size", "period", r6("ic").alias("ic"), r6("rank_ic").alias("rank_ic"), "days", r6("aer", 5).alias("aer"), r6("ir", 5).alias("ir"))


@query(
    "evaluate_weights",
    f"""with {GRID} select we.size, period, factor_id, round(avg(w), 6) as mean_weight, round(avg((w <= 1e-12)::int::double), 6) as paused
    from (select *, coalesce(case when tot > 0 then s / tot end, 1 / n::double) w from we) we join dates using (date) join per on date_idx between since and upto group by all""",
)
def _(spark, sf_dir):
    """How each set's smoothed weights fell out by period."""
    f, _, periods = _grid(spark, sf_dir)
    out = evaluation.weights_by_period(f, BASKET, SIZES, periods, HORIZON, HALFLIFE, WARM_UP)
    return out.select("size", "period", "factor_id", r6("mean_weight").alias("mean_weight"), r6("paused").alias("paused"))


@query("backtest_dropn")
def _(spark, sf_dir):
    """Both combinations side by side, each its own fold over time."""
    panel = P.supplier_panel(spark, sf_dir)
    b = basket(spark, sf_dir, panel)
    runs = combine.equal_weight(b).withColumn("run_id", F.lit("equal")).unionByName(
        combine.weighted(b, combine.ewma_weights(b, HALFLIFE, WARM_UP, HORIZON)).withColumn("run_id", F.lit("ewma"))
    )
    return backtest.top_k_drop_n(runs, market(panel), HORIZON)


@query(
    "ewma_summary",
    f"""with {EWMA}, {SPLIT} select factor_id, round(avg(weight), 6) as mean_weight, round(avg((weight <= 1e-12)::int::double), 6) as paused
    from ew, sp where date_idx > s group by 1""",
)
def _(spark, sf_dir):
    b = basket(spark, sf_dir)
    out = reports.weight_summary(combine.ewma_weights(b, HALFLIFE, WARM_UP, HORIZON), _last_train(b))
    return out.select("factor_id", r6("mean_weight").alias("mean_weight"), r6("paused").alias("paused"))


@query(
    "combine_subset",
    f"""with {BASKET_SQL}, {RANKS}, {pearson('rk', 'rv', 'rf', 'ric')}, {SPLIT},
    ok as (select factor_id from ric, sp where date_idx > s group by 1 having avg(ic) > 0)
    select date, instrument, round(avg(value), 6) as pred from ft join ok using (factor_id) group by 1, 2""",
)
def _(spark, sf_dir):
    """The mean of those features whose rank IC is still positive after the training dates."""
    v = member_values(spark, sf_dir, BASKET)
    b = combine.rank_normalized(v)
    kept = reports.still_valid(metrics.daily_rank_ic(v), _last_train(v))
    return combine.equal_weight(b.join(F.broadcast(kept), "factor_id")).select("date", "instrument", r6("pred").alias("pred"))


@query("combine_gbt")
def _(spark, sf_dir):
    b = basket(spark, sf_dir)
    return combine.gbt(b, list(BASKET), _last_train(b)).select("date", "instrument", "pred")


@query("combine_leafwise")
def _(spark, sf_dir):
    b = basket(spark, sf_dir)
    return combine.leafwise(b, list(BASKET), _last_train(b), trees=8).select("date", "instrument", "pred")


@query("combine_mlp")
def _(spark, sf_dir):
    b = basket(spark, sf_dir)
    return combine.mlp(b, list(BASKET), _last_train(b), passes=12).select("date", "instrument", "pred")


@query("mine_offline")
def _(spark, sf_dir):
    """Members that a short offline search admits on supplier months, under gates that are open but for turnover and likeness."""
    from panelforge.search.proposer import TemplateProposer
    from panelforge.search.tree import mine

    found = zoo.Zoo(zoo.Criteria(-1.0, -10.0, 2.1, max_hac_pvalue=1.0, max_control_ic=1.0, min_block_frac=0.0, min_q_spread=-1e9))
    mine(spark, with_forward(P.supplier_panel(spark, sf_dir)), TemplateProposer(), found, HORIZON)
    return found.table(spark).select("seq", "factor_id", "expression", "rank_ic", "rank_ir", "turnover", "coverage")
