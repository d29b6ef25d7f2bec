"""The repository of admitted factors: relative ranks, admission gates, exemplars, JSON."""

from __future__ import annotations

import json
import operator
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.gram import Gram


@dataclass(frozen=True)
class Criteria:
    """Admission thresholds (fixed values: the defaults)."""

    min_rank_ic: float = 0.015
    min_rank_ir: float = 0.3
    max_turnover: float = 1.6
    max_correlation: float = 0.8
    max_rel_rank: float = 0.95
    max_hac_pvalue: float = 0.05
    min_block_frac: float = 0.6
    min_year_frac: float = 0.6
    max_control_ic: float = 0.02
    max_recon_r2: float = 0.8
    min_q_spread: float = 0.0
    min_ls_sharpe: float = 0.0
    min_q_monotonic: float = 0.0
    require_valid_sign: bool = False


METRICS = (
    "ic", "ic_ir", "rank_ic", "rank_ir", "turnover", "coverage", "max_corr", "hac_t", "hac_p", "block_pos_frac", "year_pos_frac",
    "control_ic", "recon_r2", "q_spread", "q_monotonic", "ls_sharpe", "rank_ic_valid", "rank_ir_valid",
)


def relative_rank(candidates: DataFrame, zoo: DataFrame, metric: str, higher: bool = True, name: str | None = None) -> DataFrame:
    """``candidates`` with the share of the zoo that is strictly better; 0 for an unknown value or an empty zoo.

    The zoo is at most some thousand rows: its values are gathered in one sorted array.
    """
    known = F.array_sort(F.collect_list(metric))
    of_zoo = zoo.agg(known.alias("__v"), F.count("*").alias("__n"))
    better = F.size(F.filter("__v", lambda v: v > F.col(metric) if higher else v < F.col(metric)))
    share = F.coalesce(F.try_divide(F.when(F.col(metric).isNotNull(), better), F.col("__n")), F.lit(0.0))
    return candidates.join(F.broadcast(of_zoo)).withColumn(name or f"rel_{metric}", share).drop("__v", "__n")


#: Each gate's name, the metric it looks at, when that fails, and against which threshold.
GATES = (
    ("rank_ic", "rank_ic", operator.lt, "min_rank_ic"),
    ("rank_ir", "rank_ir", operator.lt, "min_rank_ir"),
    ("turnover", "turnover", operator.gt, "max_turnover"),
    ("max_corr", "max_corr", operator.ge, "max_correlation"),
    ("rel_rank_ic", "rel_rank_ic", operator.gt, "max_rel_rank"),
    ("rel_rank_ir", "rel_rank_ir", operator.gt, "max_rel_rank"),
    ("hac_p", "hac_p", operator.gt, "max_hac_pvalue"),
    ("block", "block_pos_frac", operator.lt, "min_block_frac"),
    ("year", "year_pos_frac", operator.lt, "min_year_frac"),
    ("control", "control_ic", operator.gt, "max_control_ic"),
    ("recon", "recon_r2", operator.gt, "max_recon_r2"),
    ("spread", "q_spread", operator.le, "min_q_spread"),
    ("sharpe", "ls_sharpe", operator.lt, "min_ls_sharpe"),
    ("monotonic", "q_monotonic", operator.lt, "min_q_monotonic"),
)
#: Metrics that must be known; other unknowns pass.
REQUIRED = ("rank_ic", "rank_ir")


def gate_reasons(c: Criteria = Criteria()) -> Column:
    """Names of the gates that a row of metrics fails. Only rank IC and rank IR must be known; other unknowns pass."""
    failed = {name: F.coalesce(fails(F.col(m), F.lit(getattr(c, limit))), F.lit(m in REQUIRED)) for name, m, fails, limit in GATES}
    failed["sign"] = F.lit(c.require_valid_sign) & (F.col("rank_ic") * F.col("rank_ic_valid") <= 0)
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in failed.items())))


def reasons_of(metrics: dict[str, float | None], c: Criteria) -> list[str]:
    """``gate_reasons`` of one row at hand."""
    value = metrics.get
    failed = [name for name, m, fails, limit in GATES if (m in REQUIRED if value(m) is None else fails(value(m), getattr(c, limit)))]
    ic, valid = value("rank_ic"), value("rank_ic_valid")
    flips = c.require_valid_sign and ic is not None and valid is not None and ic * valid <= 0
    return [*failed, *["sign"] * flips]


def admission(candidates: DataFrame, zoo: DataFrame, c: Criteria = Criteria()) -> DataFrame:
    """``candidates`` with reasons and admitted, each against the zoo as it stands."""
    ranked = relative_rank(relative_rank(candidates, zoo, "rank_ic"), zoo, "rank_ir")
    return ranked.withColumn("reasons", gate_reasons(c)).withColumn("admitted", F.size("reasons") == 0)


def generalization(train: Column, valid: Column) -> Column:
    """Factor on the overfitting score by how much of the training rank IC is left in validation."""
    ratio = F.try_divide(valid, train)
    known = train.isNotNull() & valid.isNotNull() & (F.abs(train) >= 1e-12)
    return F.when(~known, 1.0).when(ratio <= 0, 0.2).when(ratio < 0.3, 0.6).when(ratio < 0.7, 0.85).otherwise(1.0)


def exemplars(zoo: DataFrame, dimension: str, corr: DataFrame | None = None, k: int = 1, eta: float = 0.5) -> DataFrame:
    """Members to show for refining a dimension.

    ``zoo``: factor_id, seq, metrics; ``corr``: other_id, corr with the candidate. None for turnover and
    overfitting; the least correlated for diversity; else the best of those left when the ``eta`` most
    correlated are dropped.
    """
    if dimension in ("turnover", "overfitting"):
        return zoo.limit(0)
    corr = zoo.select(F.col("factor_id").alias("other_id")).withColumn("corr", F.lit(0.0)) if corr is None else corr
    scored = zoo.join(corr.select(F.col("other_id").alias("factor_id"), F.abs("corr").alias("__c")), "factor_id", "left").fillna(0.0, ["__c"])
    if dimension == "diversity":
        return scored.orderBy("__c", "seq").limit(k).drop("__c")
    n = scored.count()
    left = scored.orderBy(F.desc("__c"), "seq").offset(int(n * eta)) if int(n * eta) < n else scored
    metric = {"effectiveness": "rank_ic", "monotonicity": "ls_sharpe"}.get(dimension, "rank_ir")
    return left.orderBy(F.when(F.col(metric) != 0, F.col(metric)).desc_nulls_last(), F.desc("__c"), "seq").limit(k).drop("__c")


def top_by_rank_ir(zoo: DataFrame, k: int) -> DataFrame:
    return zoo.orderBy(F.col("rank_ir").desc_nulls_last(), "seq").limit(k)


SCHEMA = T.StructType(
    [
        T.StructField("seq", T.IntegerType()), T.StructField("factor_id", T.StringType()), T.StructField("expression", T.StringType()),
        *(T.StructField(m, T.DoubleType()) for m in METRICS),
    ]
)


@dataclass
class Member:
    name: str
    expression: str
    formula: dict
    args: dict
    metrics: dict[str, float | None]
    scores: dict[str, float] = field(default_factory=dict)
    overall: float | None = None
    overfit_reason: str = ""
    description: str = ""


@dataclass
class Zoo:
    """Members in order of admission. Small by nature; values stay in tables."""

    criteria: Criteria = Criteria()
    members: list[Member] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, m.name, m.expression, *(m.metrics.get(k) for k in METRICS)) for i, m in enumerate(self.members)]
        return spark.createDataFrame(rows, SCHEMA)

    def relative_rank(self, metric: str, value: float | None, higher: bool = True) -> float:
        known = [v for m in self.members if (v := m.metrics.get(metric)) is not None]
        if value is None or not known:
            return 0.0
        return sum(v > value if higher else v < value for v in known) / len(self.members)

    def add(self, member: Member) -> list[str]:
        """Reasons against the member; none, and it is in."""
        if any(m.expression == member.expression for m in self.members):
            return ["duplicate"]
        ranks = {f"rel_{m}": self.relative_rank(m, member.metrics.get(m)) for m in REQUIRED}
        reasons = reasons_of(member.metrics | ranks, self.criteria)
        if not reasons:
            self.members.append(member)
        return reasons

    def offer(self, member: Member, likeness: Gram) -> list[str]:
        """``add`` with the likeness to the members of this moment, which goes into the member's metrics."""
        pool = [m.expression for m in self.members]
        if member.expression not in pool:
            member.metrics |= {"max_corr": likeness.max_corr(member.expression, pool), "recon_r2": likeness.recon_r2(member.expression, pool)}
        return self.add(member)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"criteria": asdict(self.criteria), "alphas": [asdict(m) for m in self.members]}, indent=1))

    @classmethod
    def load(cls, path: str) -> Zoo:
        """Metrics that a file doesn't have are unknown."""
        raw = json.loads(Path(path).read_text())
        known = {f.name for f in fields(Member)}
        return cls(Criteria(**raw["criteria"]), [Member(**{k: v for k, v in m.items() if k in known}) for m in raw["alphas"]])
