"""Command line: mine formulas, report a zoo, screen it again, evaluate combinations."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.stored import stored
from panelforge.operators import evaluation, metrics, reports
from panelforge.operators.zoo import Member, Zoo
from panelforge.plans.formula import Formula
from panelforge.search.proposer import TemplateProposer
from panelforge.search.tree import Split, mine, prepared, rescreen, saved
from panelforge.session import session
from panelforge.sources import panel as P


def by_rank_ir(members: list[Member]) -> list[Member]:
    return sorted(members, key=lambda m: -(m.metrics.get("rank_ir") or float("-inf")))


def evaluated(panel: DataFrame, zoo: Zoo, horizon: int, periods: dict[str, tuple[int, int]], sizes: list[int], models: list[str], mode: str = "topk_dropn") -> dict:
    """What the report of an evaluation holds: each member by period, each combination by period, and the smoothed weights.

    ``panel`` has fwd and ret1; ``periods``: first and last date_idx of train and of those to evaluate on.
    """
    members = by_rank_ir(zoo.members)
    trees = {m.expression: Formula.parse(m.formula).tree(m.args) for m in members}
    last = periods["train"][1]
    panel = stored(panel)
    features = stored(evaluation.features(panel, trees))
    daily = metrics.daily_rank_ic(prepared(panel, trees))
    alone = reports.period_report(daily, last).orderBy("factor_id")
    later = {name: dates for name, dates in periods.items() if name != "train"}
    pred = evaluation.combined(features, list(trees), sizes, models, last, horizon)
    market = evaluation.market(panel, panel.select("date_idx", "instrument", P.daily_return().alias("ret")))
    runs = evaluation.evaluate(pred, stored(market), later, horizon, mode).orderBy("model", "size", "period")
    out = {"per_alpha": [r.asDict() for r in alone.collect()], "combiner": [r.asDict() for r in runs.collect()]}
    if "ewma" in models:
        weights = evaluation.weights_by_period(features, list(trees), sizes, later, horizon).orderBy("size", "period", "factor_id")
        out["ewma_weights"] = [r.asDict() for r in weights.collect()]
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="panelforge", description=__doc__)
    parser.add_argument("command", choices=("mine", "report", "rescreen", "evaluate"))
    parser.add_argument("--out", default="runs/demo")
    parser.add_argument("--source", default="synthetic", choices=("synthetic", "csv"))
    parser.add_argument("--folder", help="of CSV files, one per instrument")
    parser.add_argument("--horizon", type=int, default=5)
    parser.add_argument("--trees", type=int, default=2)
    parser.add_argument("--budget", type=int, default=3, help="steps of a tree, before what better scores earn it")
    parser.add_argument("--parallel", type=int, default=1, help="trees at a time")
    parser.add_argument("--target", type=int, help="begin no tree once the zoo has as many members")
    parser.add_argument("--values", help="shared folder in which factor values are kept between steps and runs")
    parser.add_argument("--resume", action="store_true", help="go on from the zoo that is in --out")
    parser.add_argument("--strict-out", help="where a screened zoo goes")
    parser.add_argument("--keep-rel-rank", action="store_true")
    parser.add_argument("--models", default="equal,ewma")
    parser.add_argument("--sizes", default="10", help="numbers of members, or all")
    parser.add_argument("--mode", default="topk_dropn", choices=("topk_dropn", "periodic"))
    a = parser.parse_args(argv)
    zoo_file = Path(a.out) / "zoo.json"
    spark = session(spark__scheduler__mode="FAIR")
    if a.command == "report":
        Zoo.load(str(zoo_file)).table(spark).orderBy(F.col("rank_ir").desc_nulls_last()).show(100, truncate=60)
        return
    panel = P.load_panel(spark, a.source, **({"folder": a.folder} if a.source == "csv" else {})).withColumns({"fwd": P.forward_return(a.horizon), "ret1": P.forward_return(1)})
    if a.command == "mine":
        zoo = Zoo.load(str(zoo_file)) if a.resume and zoo_file.exists() else Zoo()
        keep = saved(a.out)
        count = mine(
            spark, panel, TemplateProposer(most_window=60), zoo, a.horizon, trees=a.trees, budget=a.budget, most_budget=max(6, 2 * a.budget), parallel=a.parallel,
            stopped_at=a.target, folder=a.values, checkpoint=keep,
        )
        zoo_file.parent.mkdir(parents=True, exist_ok=True)
        zoo.save(str(zoo_file))
        print(json.dumps(vars(count)))
        return
    zoo = Zoo.load(str(zoo_file))
    n = panel.agg(F.max("date_idx") + 1).first()[0]
    split = Split.at(n)
    if a.command == "rescreen":
        fresh, told = rescreen(panel, zoo, a.horizon, split, keep_rel_rank=a.keep_rel_rank)
        at = Path(a.strict_out or f"{a.out}_strict")
        at.mkdir(parents=True, exist_ok=True)
        fresh.save(str(at / "zoo.json"))
        print(json.dumps({"kept": len(fresh.members), "of": len(told), "dropped": {e: why for e, why in told if why}}))
        return
    sizes = [len(zoo.members) if s == "all" else int(s) for s in a.sizes.split(",")]
    results = evaluated(panel, zoo, a.horizon, {"train": split.train, "test": split.valid or split.train}, sizes, a.models.split(","), a.mode)
    (Path(a.out) / "evaluation.json").write_text(json.dumps(results, indent=1))
    print(json.dumps(results["combiner"]))


if __name__ == "__main__":
    main()
