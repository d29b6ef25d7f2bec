import pytest
from pyspark.sql import functions as F

from panelforge.operators import metrics
from panelforge.plans.compiler import factor_values
from panelforge.plans.queries import ORACLES, QUERIES, SIGNAL, with_forward
from panelforge.search.proposer import TemplateProposer, corrected, extract_json
from panelforge.plans.formula import FormulaError
from panelforge.sources import panel as P


def test_dense_grid_and_repeated_cells(spark):
    rows = spark.createDataFrame([("2020-01-01", "b", 1.0), ("2020-01-03", "a", 2.0)], "date string, instrument string, close double")
    rows = rows.withColumn("date", F.col("date").cast("date"))
    got = P.dense(rows).orderBy("date_idx", "inst_ord").collect()
    assert [(r.date_idx, r.instrument, r.close) for r in got] == [(0, "a", None), (0, "b", 1.0), (1, "a", 2.0), (1, "b", None)]
    with pytest.raises(Exception, match="twice"):
        P.dense(rows.union(rows)).collect()


def test_returns_with_and_without_padding(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, None, 2.0, 3.0])], "date_idx int, close double").withColumn("instrument", F.lit("a"))
    got = rows.select("date_idx", P.daily_return().alias("pad"), P.daily_return(False).alias("none"), P.forward_return(2).alias("fwd")).orderBy("date_idx").collect()
    assert [r.pad for r in got] == [None, 0.0, 1.0, 0.5] and [r.none for r in got] == [None, None, None, 0.5] and [r.fwd for r in got] == [1.0, None, None, None]


def test_universe_rotates_and_intervals_are_half_open(spark):
    day = lambda *d: [(x,) for x in d]
    grid = spark.createDataFrame(day("2020-01-15", "2020-02-15", "2020-03-15"), "date string").crossJoin(spark.createDataFrame(day("a", "b"), "instrument string"))
    grid = grid.withColumn("date", F.col("date").cast("date"))
    snaps = spark.createDataFrame([("2020-02-01", "a"), ("2020-03-01", "b")], "date string, instrument string").withColumn("date", F.col("date").cast("date"))
    got = {(str(r.date), r.instrument): r.in_universe for r in P.universe_asof(grid, snaps).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [("2020-02-15", "a"), ("2020-03-15", "b")]
    iv = spark.createDataFrame([("a", "x", "2020-01-15", "2020-03-15", 0), ("a", "y", "2020-02-15", None, 1)], "instrument string, industry string, in_date string, out_date string, seq int")
    iv = iv.withColumns({c: F.col(c).cast("date") for c in ("in_date", "out_date")})
    got = {str(r.date): r.industry for r in P.industry_on(grid, iv).where("instrument = 'a'").collect()}
    assert got == {"2020-01-15": "x", "2020-02-15": "y", "2020-03-15": "y"}


def test_csv_panel(spark, tmp_path):
    (tmp_path / "AA.csv").write_text("Date, Open ,High,Low,Close,Volume\n2020-01-01,1,4,1,2,10\n20200102,2,3,2,inf,5\n")
    got = P.csv_panel(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.instrument, r.vwap, r.close) for r in got] == [("AA", 2.0, 2.0), ("AA", None, None)]
    with pytest.raises(ValueError):
        P.load_panel(spark, "nope")


def test_synthetic_panel_is_repeatable_and_has_signal(spark):
    p = with_forward(P.synthetic_panel(spark, 20, 120), 5)
    assert p.count() == 2400 and p.where("high < low or close <= 0").count() == 0
    v = factor_values(p, {"f": SIGNAL}, ("fwd",))
    a, b = (metrics.mean_and_ir(metrics.daily_rank_ic(v)).first().mean for _ in range(2))
    assert a == b


def test_splits():
    assert P.split_at(10, 0.7) == 6 and P.split_at(1, 0.1) == 0


def test_every_query_with_sql_is_registered():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 85


def test_answers_are_corrected(spark):
    answers = iter(["no json", '{"formula": []}', 'so: {"formula": [{"op": "Neg", "inputs": "close", "output": "x"}], "arguments": {}} end'])
    errors = []
    f = corrected(lambda e: (errors.append(e), next(answers))[1])
    assert f.text() == "Neg(close)" and errors[0] is None and len(errors) == 3
    with pytest.raises(FormulaError):
        extract_json("nothing")


def test_proposer_is_seeded_and_avoids(spark):
    a, b = TemplateProposer(3), TemplateProposer(3)
    assert [a.propose([]).to_json() for _ in range(4)] == [b.propose([]).to_json() for _ in range(4)]
    avoided = {TemplateProposer(i).propose(["Neg(Pct(close,t))"]).name for i in range(12)}
    assert "reversal" not in avoided


def test_a_panel_reads_the_order_lines_once(spark):
    """Its plan begins at the stored bars: the lines are read by the one job that stores them."""
    tracker = spark.sparkContext
    tracker.setJobGroup("panel", "")
    p = P.supplier_panel(spark, "/root/testdata/sf0.001")
    read = len(tracker.statusTracker().getJobIdsForGroup("panel"))
    plan = p._jdf.queryExecution().executedPlan().toString()
    tracker.setLocalProperty("spark.jobGroup.id", None)
    assert "lineitem" not in plan and "FileScan" not in plan and read >= 1 and p.count() > 0
