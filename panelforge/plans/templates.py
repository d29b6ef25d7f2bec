"""Ready-made formulas: the shapes a search starts from, with windows to be filled in."""

from __future__ import annotations

from dataclasses import dataclass

from panelforge.functions.factors import operators
from panelforge.plans.formula import Formula


@dataclass(frozen=True)
class Expr:
    """A field, or an operator over expressions with names of windows; written with - * / and calls."""

    name: str
    inputs: tuple[Expr, ...] = ()
    windows: tuple[str, ...] = ()

    def __sub__(self, other: Expr) -> Expr:
        return Expr("Sub", (self, other))

    def __mul__(self, other: Expr) -> Expr:
        return Expr("Mul", (self, other))

    def __truediv__(self, other: Expr) -> Expr:
        return Expr("Div", (self, other))

    def __neg__(self) -> Expr:
        return Expr("Neg", (self,))

    def steps(self) -> list[dict]:
        """Single assignments, inputs before what uses them; equal expressions are one step."""
        out: dict[Expr, str] = {}

        def name(e: Expr) -> str:
            if not e.inputs:
                return e.name
            if e not in out:
                inputs = [name(x) for x in e.inputs]
                made.append({"name": e.name, "param": list(e.windows), "input": inputs, "output": f"v{len(made) + 1}"})
                out[e] = made[-1]["output"]
            return out[e]

        made: list[dict] = []
        name(self)
        return made


def call(op: str):
    def of(*parts: Expr | str) -> Expr:
        return Expr(op, tuple(p for p in parts if isinstance(p, Expr)), tuple(p for p in parts if isinstance(p, str)))

    return of


def shapes() -> dict[str, tuple[Expr, dict[str, int]]]:
    """Shapes (fixed) and windows for monthly data."""
    close, volume, vwap, high, low = map(Expr, ("close", "volume", "vwap", "high", "low"))
    f = {o.name: call(o.name) for o in operators()}
    pct, mean, least, most = f["Pct"], f["Ma"], f["Min"], f["Max"]
    return {
        "reversal": (-pct(close, "a"), {"a": 2}),
        "stretched_reversal": (-f["Zscore"](pct(close, "a"), "b"), {"a": 1, "b": 6}),
        "pressure": (f["Zscore"](mean(close - vwap, "a"), "b"), {"a": 4, "b": 8}),
        "price_volume": (-f["Corr"](close, volume, "a"), {"a": 6}),
        "heavy_reversal": (-(pct(close, "b") * (volume / mean(volume, "a"))), {"a": 6, "b": 2}),
        "calm": (-f["Std"](pct(vwap, "a"), "b"), {"a": 1, "b": 6}),
        "range_place": (-((close - least(low, "a")) / (most(high, "a") - least(low, "a"))), {"a": 6}),
        "volume_trend": (f["Diff"](mean(volume, "a"), "k") / mean(volume, "b"), {"a": 3, "b": 8, "k": 2}),
        "lottery": (-f["Skew"](pct(close, "a"), "b"), {"a": 1, "b": 8}),
        "persistence": (f["Autocorr"](pct(close, "a"), "b", "k"), {"a": 1, "b": 8, "k": 2}),
        "low_rank": (-f["Rank"](close, "a"), {"a": 6}),
        "volume_noise": (f["Zscore"](f["Vari"](volume, "a"), "b"), {"a": 4, "b": 6}),
    }


TEMPLATES = shapes()


def formula_of(shape: str, **windows: int) -> Formula:
    body, defaults = TEMPLATES[shape]
    return Formula.parse({"name": shape, "formula": body.steps(), "arguments": [defaults | windows]})
