"""Many formulas at once as one plan over the panel.

Equal subtrees of any of the formulas become one column, so nothing is computed twice; a subtree is a
column as soon as its children are, so windows never nest. The means, counts and deviations of a level's
windows are columns, too, that different operators share. All windows share one partitioning and order: the
plan has one exchange and one sort, whatever the number of formulas.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.factors import operator
from panelforge.functions.windows import shared
from panelforge.plans.formula import Node

KEYS = ("date", "date_idx", "instrument", "inst_ord")


def _with_lags(node: Node) -> Node:
    """Autocorr's lagged series made a node of its own."""
    children = tuple(_with_lags(c) for c in node.children)
    if node.op and node.op.name == "Autocorr":
        children = (*children, Node(operator("Delay"), "Delay", children[:1], node.params[1:]))
    return Node(node.op, node.name, children, node.params)


def wide(panel: DataFrame, factors: Mapping[str, Node], keep: tuple[str, ...] = ()) -> DataFrame:
    """The panel's keys and ``keep``, with a column per factor."""
    trees = {name: _with_lags(node) for name, node in factors.items()}
    nodes = dict.fromkeys(n for t in trees.values() for n, _ in t.subtrees())
    column = {n: n.name if n.op is None else f"__{i}" for i, n in enumerate(nodes)}
    fields = sorted({n.name for n in nodes if n.op is None} | set(keep))
    df = panel.select(*KEYS, *(f for f in fields if f not in KEYS))
    for depth in range(2, 1 + max((t.depth for t in trees.values()), default=0)):
        level = {}
        with shared(f"__w{depth}_") as windows:
            for n in nodes:
                if n.op is not None and n.depth == depth:
                    x = [F.col(column[c]) for c in n.children]
                    level[column[n]] = n.op(*x[: n.op.inputs], *n.params, *x[n.op.inputs :])
        df = df.withColumns(dict(windows.values())).withColumns(level).drop(*(name for name, _ in windows.values()))
    return df.select(*KEYS, *keep, *(F.col(column[t]).alias(name) for name, t in trees.items()))


def long(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """factor_id, keys, keep, value: one row per factor and cell."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("factor_id"), F.col(n).cast("double").alias("value")) for n in names)))
    return df.select(*KEYS, *keep, pairs.alias("f")).select("f.factor_id", *KEYS, *keep, "f.value")


def factor_values(panel: DataFrame, factors: Mapping[str, Node], keep: tuple[str, ...] = ()) -> DataFrame:
    return long(wide(panel, factors, keep), list(factors), keep)
