"""The operators of the formula language as Column recipes, and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.windows import both, clean, full, over, rolling, time

#: Below this population variance a window that isn't constant has no moments of higher order.
LEAST_VARIANCE = 1e-14


@dataclass(frozen=True)
class Operator:
    """``build`` takes the input columns and then the whole-number parameters."""

    name: str
    inputs: int
    params: tuple[str, ...]
    build: Callable[..., Column]
    aliases: tuple[str, ...] = ()
    temporal: bool = False

    def __call__(self, *args) -> Column:
        return clean(self.build(*args))


_registry: dict[str, Operator] = {}


def register(op: Operator) -> Operator:
    """Add an operator; its name and aliases are found in any case."""
    for name in (op.name, *op.aliases):
        _registry[name.lower()] = op
    return op


def operator(name: str) -> Operator | None:
    return _registry.get(name.lower())


def operators() -> list[Operator]:
    return list(dict.fromkeys(_registry.values()))


def _lag(x: Column, n: int) -> Column:
    return over(F.lag(x, n), time())


def _pct(x: Column, n: int) -> Column:
    return F.try_divide(x, _lag(x, n)) - 1


def _mean(x: Column, t: int) -> Column:
    return full(x, t, over(F.avg(x), rolling(t)))


def _std(x: Column, t: int) -> Column:
    return full(x, t, over(F.stddev_samp(x), rolling(t)))


def _rank(x: Column, t: int) -> Column:
    seen = over(F.collect_list(x), rolling(t))
    less, equal = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return full(x, t, (less + (equal + 1) / 2) / t)


def _constant(x: Column, t: int) -> Column:
    return over(F.min(x), rolling(t)) == over(F.max(x), rolling(t))


def _skew(x: Column, t: int) -> Column:
    if t < 3:
        return F.lit(None).cast("double")
    varied = F.when(over(F.var_pop(x), rolling(t)) > LEAST_VARIANCE, over(F.skewness(x), rolling(t)) * ((t * (t - 1)) ** 0.5 / (t - 2)))
    return full(x, t, F.when(_constant(x, t), F.lit(0.0)).otherwise(varied))


def _kurt(x: Column, t: int) -> Column:
    if t < 4:
        return F.lit(None).cast("double")
    excess = ((t + 1) * over(F.kurtosis(x), rolling(t)) + 6) * ((t - 1) / ((t - 2) * (t - 3)))
    varied = F.when(over(F.var_pop(x), rolling(t)) > LEAST_VARIANCE, excess)
    return full(x, t, F.when(_constant(x, t), F.lit(-3.0)).otherwise(varied))


def _cov(x: Column, y: Column, t: int) -> Column:
    x, y = both(x, y)
    return full(x, t, over(F.covar_samp(x, y), rolling(t)))


def _corr(x: Column, y: Column, t: int) -> Column:
    a, b = both(x, y)
    return F.try_divide(_cov(x, y, t), _std(a, t) * _std(b, t))


def _slope(x: Column, y: Column, t: int) -> Column:
    a, _ = both(x, y)
    return F.try_divide(_cov(x, y, t), full(a, t, over(F.var_samp(a), rolling(t))))


for _op in (
    Operator("Neg", 1, (), lambda x: -x, ("Opposite", "Negative")),
    Operator("Abs", 1, (), F.abs),
    Operator("Square", 1, (), lambda x: x * x, ("Pow2",)),
    Operator("Inverse", 1, (), lambda x: F.try_divide(F.lit(1.0), x), ("Inv",)),
    Operator("Sign", 1, (), F.signum),
    Operator("Sin", 1, (), F.sin),
    Operator("Cos", 1, (), F.cos),
    Operator("Tanh", 1, (), F.tanh),
    Operator("Log", 1, (), lambda x: F.when(x > 0, F.ln(x))),
    Operator("Delay", 1, ("t",), _lag, (), True),
    Operator("Diff", 1, ("t",), lambda x, t: x - _lag(x, t), (), True),
    Operator("Pct", 1, ("t",), _pct, ("Ret", "Roc"), True),
    Operator("Ma", 1, ("t",), _mean, ("Mean", "Sma"), True),
    Operator("Med", 1, ("t",), lambda x, t: full(x, t, over(F.percentile(x, F.lit(0.5)), rolling(t))), ("Median",), True),
    Operator("Sum", 1, ("t",), lambda x, t: full(x, t, over(F.sum(x), rolling(t))), (), True),
    Operator("Std", 1, ("t",), _std, (), True),
    Operator("Max", 1, ("t",), lambda x, t: full(x, t, over(F.max(x), rolling(t))), (), True),
    Operator("Min", 1, ("t",), lambda x, t: full(x, t, over(F.min(x), rolling(t))), (), True),
    Operator("Rank", 1, ("t",), _rank, ("TsRank",), True),
    Operator("Skew", 1, ("t",), _skew, (), True),
    Operator("Kurt", 1, ("t",), _kurt, (), True),
    Operator("Vari", 1, ("t",), lambda x, t: F.try_divide(_std(x, t), _mean(x, t)), ("Variation",), True),
    Operator("Zscore", 1, ("t",), lambda x, t: F.try_divide(x - _mean(x, t), _std(x, t)), (), True),
    # the lagged series is a column of its own by the time this is built: see plans.compiler
    Operator("Autocorr", 1, ("t", "n"), lambda x, t, n, lagged: _corr(x, lagged, t), (), True),
    Operator("Add", 2, (), lambda x, y: x + y, ("Plus",)),
    Operator("Sub", 2, (), lambda x, y: x - y, ("Minus", "Subtract")),
    Operator("Mul", 2, (), lambda x, y: x * y, ("Multiply", "Times")),
    Operator("Div", 2, (), F.try_divide, ("Divide",)),
    Operator("Greater", 2, (), lambda x, y: (x > y).cast("double"), ("Gt",)),
    Operator("Less", 2, (), lambda x, y: (x < y).cast("double"), ("Lt",)),
    Operator("Cov", 2, ("t",), _cov, ("Covariance",), True),
    Operator("Corr", 2, ("t",), _corr, ("Correlation",), True),
    Operator("TsRegress", 2, ("t",), _slope, ("ts_regress", "Regress", "RegSlope", "Beta"), True),
):
    register(_op)
