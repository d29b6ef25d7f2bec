"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelforge.plans.compiler import wide
from panelforge.plans.queries import OPERATOR_TREES, QUERIES
from panelforge.session import session
from panelforge.sources.panel import supplier_panel

HEADLINE = ("bars_sm", "op_zscore", "op_corr", "op_rank", "rank_ic", "mean_ir", "turnover", "quantile_means", "neutralize", "zoo_metrics", "combine_ewma", "backtest_periodic")


#: How many operators are compiled into one plan.
BATCHES = (1, 10, 33)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["mean_ir"](spark, sf_dir).collect()  # code is compiled and files are known from here on
    plans = {name: QUERIES[name] for name in HEADLINE}
    for n in BATCHES:
        plans[f"batch_{n}"] = lambda s, d, trees=dict(list(OPERATOR_TREES.items())[:n]): wide(supplier_panel(s, d), trees)
    took = {}
    for name, plan in plans.items():
        began = time.perf_counter()
        plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline factor queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
