import pytest

from panelforge.functions.factors import operator, operators
from panelforge.plans.formula import Formula, FormulaError
from panelforge.plans.subtrees import closed_genes, forbidden_gene, gene_table, genes
from panelforge.plans.templates import TEMPLATES, formula_of

#: how rises of the high go with volume, turned around; the windows are k and n
RISE = {
    "name": "rise",
    "formula": [
        {"op": "Diff", "params": ["k"], "inputs": ["high"], "output": "up"},
        {"name": "correlation", "param": "n", "input": ["up", "volume"], "output": "both"},
        {"name": "NEG", "input": "both", "output": "out"},
    ],
    "arguments": [{"k": 3, "n": 9}, {"k": 1.6, "n": 17}],
}


def changed(**more):
    return RISE | more


def test_registry_has_all_operators_and_finds_aliases_in_any_case():
    assert len(operators()) == 33
    assert operator("SMA") is operator("Ma") and operator("beta").name == "TsRegress" and operator("nope") is None


def test_parse_renders_and_rounds_arguments():
    f = Formula.parse(RISE)
    assert [f.text(a) for a in f.arguments] == ["Neg(Corr(Diff(high,3),volume,9))", "Neg(Corr(Diff(high,2),volume,17))"]
    assert Formula.parse(f.to_json()).text() == f.text() == "Neg(Corr(Diff(high,k),volume,n))"
    assert (f.tree().size, f.tree().depth, f.name) == (5, 4, "rise")


def test_only_three_argument_sets_are_kept():
    assert Formula.parse(changed(arguments=[{"k": 2, "n": i} for i in range(4, 11)])).arguments == [{"k": 2, "n": i} for i in (4, 5, 6)]


@pytest.mark.parametrize(
    "bad",
    [
        "[", [], {}, changed(arguments=[]), changed(arguments=[3]), changed(arguments=[{"n": 9}]), changed(arguments=[{"k": 1, "n": 9, "z": 3}]), changed(arguments=[{"k": "x", "n": 9}]),
        changed(arguments=[{"k": 121, "n": 9}]), changed(arguments=[{"k": 0.4, "n": 9}]), changed(arguments=[{"k": False, "n": 9}]), changed(formula=[7]), changed(formula=[{"name": "Neg", "input": "low"}]),
        changed(formula=[{"name": "Magic", "input": ["close"], "output": "x"}]), changed(formula=[{"name": "Add", "input": ["close"], "output": "x"}]),
        changed(formula=[{"name": "Neg", "input": ["nope"], "output": "x"}]), changed(formula=[{"name": "Neg", "input": ["1.5"], "output": "x"}]),
        changed(formula=[{"name": "Neg", "input": ["close"], "output": "open"}]), changed(formula=[{"name": "Ma", "input": ["close"], "output": "x"}]),
        changed(formula=[{"name": "Neg", "input": ["close"], "output": "x"}, {"name": "Abs", "input": ["close"], "output": "x"}]),
    ],
)
def test_errors_are_formula_errors(bad):
    with pytest.raises(FormulaError):
        Formula.parse(bad)


def test_closed_genes_leave_out_those_a_parent_is_as_frequent_as(spark):
    def f(*steps):
        return Formula.parse({"formula": [{"name": o, "param": p, "input": x, "output": y} for o, p, x, y in steps], "arguments": [{"t": 5} if any(s[1] for s in steps) else {}]}).tree()

    both = f(("Ma", ["t"], ["close"], "m"), ("Zscore", ["t"], ["m"], "z"))
    trees = [both, both, both, f(("Ma", ["t"], ["close"], "m")), f(("Std", ["t"], ["volume"], "s"))]
    rows = closed_genes(gene_table(spark, trees), 5, top_k=5).collect()
    assert [(r.gene, r.support) for r in rows] == [("Ma(close,t)", 0.8), ("Zscore(Ma(close,t),t)", 0.6)]
    assert genes(both) == {"Ma(close,t)", "Zscore(Ma(close,t),t)"}
    assert forbidden_gene(both, ["Std(volume,t)", "Ma(close,t)"]) == "Ma(close,t)"


def test_all_templates_are_valid():
    assert len(TEMPLATES) == 12 and all(formula_of(s).arguments for s in TEMPLATES)
