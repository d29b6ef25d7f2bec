"""Monte Carlo tree search over formulas."""

from __future__ import annotations

import json
import logging
import math
import random
import threading
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import longshort, metrics, robustness
from panelforge.operators.gram import gram
from panelforge.operators.neutralize import in_universe, neutralize
from panelforge.operators.zoo import Criteria, Member, Zoo, exemplars, generalization
from panelforge.plans.compiler import factor_values
from panelforge.plans.formula import Formula, FormulaError, Node
from panelforge.plans.subtrees import closed_genes, forbidden_gene, gene_table
from panelforge.search.proposer import Context, Proposer, Refinement, overfit_score
from panelforge.search.store import ValueStore
from panelforge.sources.panel import forward_return

log = logging.getLogger(__name__)
DIMENSIONS = ("effectiveness", "stability", "turnover", "diversity", "overfitting", "monotonicity")


@dataclass
class Candidate:
    formula: Formula
    arguments: dict
    metrics: dict[str, float | None]
    scores: dict[str, float]
    reason: str = ""
    alike: dict[str, float] = field(default_factory=dict)
    """Correlations with the members of the zoo at the time, by their expressions."""

    @property
    def overall(self) -> float:
        return sum(self.scores.values()) / len(self.scores)

    @property
    def expression(self) -> str:
        return self.formula.text(self.arguments)


@dataclass
class Place:
    candidate: Candidate
    parent: Place | None = None
    children: list[Place] = field(default_factory=list)
    visits: int = 1
    best: float = 0.0
    dimension: str = ""
    """What its step was to better."""

    @property
    def refinement(self) -> Refinement:
        a, b = self.parent.candidate, self.candidate
        return Refinement(self.dimension, a.expression, b.expression, a.scores, b.scores)


def context_of(place: Place, exemplars: Sequence[dict] = ()) -> Context:
    """Path from the root, and what was tried on the parent and on the place itself."""
    path, at = [], place
    while at.parent is not None:
        path.append(at.refinement)
        at = at.parent
    siblings = [c.refinement for c in place.parent.children if c is not place] if place.parent else []
    return Context(tuple(path[::-1]), tuple(siblings), tuple(c.refinement for c in place.children), tuple(exemplars))


@dataclass(frozen=True)
class Split:
    """First and last ordinal of the training dates and, maybe, of those held out for validation."""

    train: tuple[int, int]
    valid: tuple[int, int] | None = None

    @classmethod
    def at(cls, n_dates: int, share: float = 0.7) -> Split:
        """The first ``share`` of the dates to train on, the others to validate."""
        last = min(max(int(n_dates * share) - 1, 0), n_dates - 1)
        return cls((0, last), (last + 1, n_dates - 1) if last + 1 < n_dates else None)


def prepared(panel: DataFrame, trees: dict[str, Node]) -> DataFrame:
    """Factor values over the whole history with fwd and ret1 (the next period's return): neutralised, then members only.

    Industry, log_mv and in_universe are used where ``panel`` has them; of what isn't in the universe neither
    values nor returns count.
    """
    keep = [c for c in ("fwd", "ret1", "industry", "log_mv", "in_universe") if c in panel.columns]
    values = neutralize(factor_values(panel, trees, tuple(keep)))
    if "in_universe" not in keep:
        return values
    out = in_universe(values)
    return out.withColumns({c: F.when(F.col("in_universe"), F.col(c)) for c in ("fwd", "ret1")})


@contextmanager
def values_of(panel: DataFrame, trees: dict[str, Node], store: ValueStore | None) -> Iterator[DataFrame]:
    """``prepared`` values, from the store if there is one, else evaluated and kept while they are used."""
    if store is not None:
        yield store.values(trees)
        return
    values = metrics.dealt(prepared(panel, trees)).persist()
    try:
        yield values
    finally:
        values.unpersist()


def within(values: DataFrame, dates: tuple[int, int]) -> DataFrame:
    return values.where(F.col("date_idx").between(*dates))


def shape_of(values: DataFrame) -> DataFrame:
    """factor_id, valid_days (dates with three values at least), deviation (the largest of a day's)."""
    daily = values.groupBy("factor_id", "date").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"))
    return daily.groupBy("factor_id").agg(F.sum((F.col("n") >= 3).cast("int")).alias("valid_days"), F.coalesce(F.max("sd"), F.lit(0.0)).alias("deviation"))


def full_metrics(values: DataFrame, split: Split, horizon: int, block_least: int = 20, year_least: int = 60) -> DataFrame:
    """One row per factor: every metric of the training dates, rank IC and IR of the validation dates, and the factor on the
    overfitting score that these two make."""
    train = within(values, split.train)
    # rows by factor and date, or bucket, that several metrics are made of: ranked once for all of them
    ic, means = metrics.daily_rank_ic(train).persist(), longshort.quantile_means(train).persist()
    next_period = train.withColumn("fwd", F.col("ret1"))
    out = (
        metrics.alpha_metrics(train, rank_ic=ic).join(shape_of(train), "factor_id")
        .join(robustness.newey_west(ic, horizon).select("factor_id", F.col("t").alias("hac_t"), F.col("p").alias("hac_p")), "factor_id", "left")
        .join(robustness.block_fraction(ic, least=block_least).withColumnRenamed("fraction", "block_pos_frac"), "factor_id", "left")
        .join(robustness.year_fraction(ic, year_least).withColumnRenamed("fraction", "year_pos_frac"), "factor_id", "left")
        .join(robustness.asset_mismatch(train).withColumnRenamed("control", "control_ic"), "factor_id", "left")
        .join(longshort.quantile_spread(means).withColumnRenamed("spread", "q_spread"), "factor_id", "left")
        .join(longshort.monotonic_fraction(means).withColumnRenamed("monotonic", "q_monotonic"), "factor_id", "left")
        .join(longshort.annual_sharpe(longshort.long_short_returns(next_period)).withColumnRenamed("sharpe", "ls_sharpe"), "factor_id", "left")
    )
    if split.valid:
        held_out = metrics.mean_and_ir(metrics.daily_rank_ic(within(values, split.valid)), mean="rank_ic_valid", ir="rank_ir_valid")
        out = out.join(held_out, "factor_id", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("rank_ic_valid", "rank_ir_valid")})
    order = longshort.monotonicity_score(F.col("q_spread"), F.col("q_monotonic"), F.col("ls_sharpe"))
    return out.withColumns({"monotonicity": order, "generalization": generalization(F.col("rank_ic"), F.col("rank_ic_valid"))})


def degenerate(expression: str, m: dict, least_coverage: float = 0.05, least_days: int = 30) -> str | None:
    """Why a factor can't rank anything, if so."""
    if m["coverage"] < least_coverage or m["valid_days"] < least_days:
        return f"{expression} has hardly any values (coverage {m['coverage']:.1%}, {m['valid_days']} days)"
    return f"{expression} has the same value for all instruments" if m["deviation"] < 1e-12 else None


def evaluate(
    panel: DataFrame, formulas: list[Formula], zoo: Zoo, horizon: int, split: Split, revisions: list[int] | None = None, least_coverage: float = 0.05, least_days: int = 30,
    store: ValueStore | None = None,
) -> list[Candidate | FormulaError]:
    """Candidates of all formulas and argument sets from one compiled plan; of each formula the set with the best training rank IC.

    ``panel`` has fwd and ret1. A formula none of whose sets can rank gives the error of its last set.
    Correlations with the members of ``zoo`` are part of the metrics before anything is scored. With a ``store``
    only what it hasn't got is evaluated, members' values least of all.
    """
    zoo = Zoo(zoo.criteria, list(zoo.members))  # others may add to it meanwhile
    trees = {f"{i}:{j}": f.tree(a) for i, f in enumerate(formulas) for j, a in enumerate(f.arguments)}
    members = {f"zoo:{i}": Formula.parse(m.formula).tree(m.args) for i, m in enumerate(zoo.members)}
    alike: dict[str, dict[str, float]] = {}
    with values_of(panel, trees | members, store) as values:
        rows = {r.factor_id: r.asDict() for r in full_metrics(values.where(F.col("factor_id").isin(list(trees))), split, horizon).collect()}
        if members:
            likeness = gram(within(values, split.train), [*trees, *members], [], split.train)
            for name in rows:
                rows[name]["max_corr"] = likeness.max_corr(name, list(members))
                alike[name] = {m.expression: likeness.correlation(name, f"zoo:{i}") or 0.0 for i, m in enumerate(zoo.members)}
    out: list[Candidate | FormulaError] = []
    for i, f in enumerate(formulas):
        best, error = None, f"no argument set of {f.text()} has a rank IC"
        for j, a in enumerate(f.arguments):
            m = rows[f"{i}:{j}"]
            if why := degenerate(f.text(a), m, least_coverage, least_days):
                error = why
            elif m["rank_ic"] is not None and (best is None or m["rank_ic"] > rows[f"{i}:{best}"]["rank_ic"]):
                best = j
        if best is None:
            out.append(FormulaError(error))
            continue
        m = {"max_corr": 0.0} | {k: v for k, v in rows[f"{i}:{best}"].items() if k != "factor_id"}
        structure, reason = overfit_score(f.tree(f.arguments[best]), revisions[i] if revisions else 0)
        scores = {
            "effectiveness": 1 - zoo.relative_rank("rank_ic", m["rank_ic"]),
            "stability": 1 - zoo.relative_rank("rank_ir", m["rank_ir"]),
            "turnover": 1 - zoo.relative_rank("turnover", m["turnover"], higher=False),
            "diversity": 1 - zoo.relative_rank("max_corr", m["max_corr"], higher=False),
            "monotonicity": m.pop("monotonicity"),
            "overfitting": structure / 10 * (general := m.pop("generalization")),
        }
        if general < 1:
            reason += f"; validation rank IC {m['rank_ic_valid']:+.4f} against {m['rank_ic']:+.4f} in training"
        out.append(Candidate(f, f.arguments[best], m, scores, reason, alike.get(f"{i}:{best}", {})))
    return out


def select(root: Place, c: float = 1.0) -> Place:
    """Down the tree by upper confidence, stopping where a new child promises at least as much as any there is."""
    at = root
    while at.children:
        log = math.log(at.visits)
        bound = {id(p): p.best + c * math.sqrt(log / p.visits) for p in at.children}
        fresh = at.candidate.overall + c * math.sqrt(log / (1 + len(at.children)))
        top = max(at.children, key=lambda p: bound[id(p)])
        if fresh >= bound[id(top)]:
            return at
        at = top
    return at


def backpropagate(leaf: Place) -> None:
    score, at = leaf.candidate.overall, leaf
    leaf.best = score
    while at.parent is not None:
        at = at.parent
        at.visits += 1
        at.best = max(at.best, score)


def weakest(scores: dict[str, float], rng: random.Random, temperature: float = 1.0) -> str:
    """A dimension drawn by how far its score is from 1."""
    weight = [math.exp((1 - scores[d]) / temperature) for d in DIMENSIONS]
    return rng.choices(DIMENSIONS, weight)[0]


@dataclass
class Counters:
    generated: int = 0
    invalid: int = 0
    added: int = 0
    trees: int = 0
    breakthroughs: int = 0
    failed: int = 0


def as_member(c: Candidate) -> Member:
    return Member(c.formula.name, c.expression, c.formula.to_json(), c.arguments, c.metrics, c.scores, c.overall, c.reason)


def admit(panel: DataFrame, candidates: list[Candidate], zoo: Zoo, split: Split, store: ValueStore | None = None) -> int:
    """Offer candidates to the zoo in turn, each measured against the members at that moment; how many got in.

    Likeness of candidates and members over the training dates comes from one job, whatever the number of candidates.
    """
    members = {m.expression: Formula.parse(m.formula).tree(m.args) for m in zoo.members}
    own = {c.expression: c.formula.tree(c.arguments) for c in candidates}
    new = [e for e in own if e not in members]
    with values_of(panel, members | own, store) as values:
        likeness = gram(within(values, split.train), [*members, *new], new, split.train)
    return sum(not zoo.offer(as_member(c), likeness) for c in candidates)


#: Metrics that a re-screening takes anew.
ROBUSTNESS = ("hac_t", "hac_p", "block_pos_frac", "year_pos_frac", "control_ic", "q_spread", "q_monotonic", "ls_sharpe")


def rescreen(
    panel: DataFrame, old: Zoo, horizon: int, split: Split, criteria: Criteria | None = None, keep_rel_rank: bool = False, store: ValueStore | None = None, **least: int
) -> tuple[Zoo, list[tuple[str, list[str]]]]:
    """Admission played again in the order in which members were found: the new zoo, and each old member's reasons against it.

    Robustness is measured anew on the training dates; likeness is to those who are in by then. Relative ranks don't
    count unless ``keep_rel_rank``: they are meant for a growing zoo and turn down what was fine then. ``least``: as in ``full_metrics``.
    """
    criteria = criteria or old.criteria
    fresh = Zoo(criteria if keep_rel_rank else replace(criteria, max_rel_rank=1.01))
    trees = {m.expression: Formula.parse(m.formula).tree(m.args) for m in old.members}
    if not trees:
        return fresh, []
    with values_of(panel, trees, store) as values:
        rows = {r.factor_id: r.asDict() for r in full_metrics(values, split, horizon, **least).collect()}
        likeness = gram(within(values, split.train), list(trees), dates=split.train)
    told = []
    for m in old.members:
        again = replace(m, metrics=m.metrics | {k: rows[m.expression][k] for k in ROBUSTNESS})
        told.append((m.expression, fresh.offer(again, likeness)))
    return fresh, told


def depth_of(place: Place) -> int:
    n = 0
    while place.parent is not None:
        n, place = n + 1, place.parent
    return n


class Search:
    """Trees over one panel and one zoo, some of them at a time.

    Steps within a tree follow each other; trees are apart, and their Spark jobs run in pools of their own, which
    share executors fairly where the session's scheduler is a fair one. Admission, what to avoid, counters and
    checkpoints are one tree's at a time. ``stopped_at``: no new tree is begun once the zoo has that many members.
    """

    def __init__(self, panel: DataFrame, proposer: Proposer, zoo: Zoo, horizon: int, split: Split, seed: int = 7, root_tries: int = 3, store: ValueStore | None = None):
        self.panel, self.proposer, self.zoo, self.horizon, self.split = panel, proposer, zoo, horizon, split
        self.seed, self.root_tries, self.store = seed, root_tries, store
        self.count, self.avoid, self.lock = Counters(), [], threading.RLock()

    def _proposed(self, tried: Callable[[Proposer], Formula]) -> Formula:
        with self.lock:  # proposers needn't be safe for threads
            return tried(self.proposer)

    def _tried(self, formula: Formula, revisions: int) -> Candidate | None:
        found = evaluate(self.panel, [formula], self.zoo, self.horizon, self.split, [revisions], store=self.store)[0]
        bad = isinstance(found, FormulaError)
        with self.lock:
            self.count.generated += 1
            self.count.invalid += bad
        return None if bad else found

    def tree(self, number: int, budget: int, most_budget: int) -> list[Candidate]:
        """The candidates of one tree. A better score than before buys it a step."""
        rng = random.Random(f"{self.seed}:{number}")
        tries = (self._tried(self._proposed(lambda p: p.propose(self.avoid)), 0) for _ in range(self.root_tries))
        first = next((c for c in tries if c), None)
        if first is None:
            return []
        root = Place(first, best=first.overall)
        places, left, spent = [root], budget, 0
        while left and spent < most_budget:
            left, spent = left - 1, spent + 1
            at = select(root)
            dimension = weakest(at.candidate.scores, rng)
            context = context_of(at, self.exemplars(dimension, at.candidate))
            formula = self._proposed(lambda p: p.propose(self.avoid, at.candidate.formula, dimension, context))
            if forbidden_gene(formula.tree(), self.avoid):
                formula = self._proposed(lambda p: p.propose(self.avoid, None))
            found = self._tried(formula, depth_of(at) + 1)
            if found is None:
                continue
            child = Place(found, at, dimension=dimension)
            at.children.append(child)
            places.append(child)
            if found.overall > root.best:
                with self.lock:
                    self.count.breakthroughs += 1
                left += 1
            backpropagate(child)
        return [p.candidate for p in places]

    def exemplars(self, dimension: str, candidate: Candidate, k: int = 1) -> list[dict]:
        """Members to show for a dimension, as ``zoo.exemplars`` picks them by their likeness to the candidate."""
        zoo = Zoo(self.zoo.criteria, list(self.zoo.members))
        if not zoo.members or dimension in ("turnover", "overfitting"):
            return []
        spark = self.panel.sparkSession
        members = zoo.table(spark).withColumn("factor_id", F.col("expression"))
        alike = spark.createDataFrame([(m.expression, candidate.alike.get(m.expression, 0.0)) for m in zoo.members], "other_id string, corr double")
        return [r.asDict() for r in exemplars(members, dimension, alike, k).collect()]

    def review(self, candidates: list[Candidate], checkpoint: Callable[[Search], None] | None) -> None:
        """What a finished tree leaves: members, structures to avoid, a checkpoint."""
        with self.lock:
            self.count.trees += 1
            if candidates:
                self.count.added += admit(self.panel, candidates, self.zoo, self.split, self.store)
            self.learn()
            if checkpoint:
                checkpoint(self)

    def learn(self) -> None:
        if len(self.zoo.members) >= 2:
            members = [Formula.parse(m.formula).tree() for m in self.zoo.members]
            self.avoid = [r.gene for r in closed_genes(gene_table(self.panel.sparkSession, members), len(members), least_support=0.5).collect()]

    def run(self, trees: int, budget: int, most_budget: int, parallel: int = 1, stopped_at: int | None = None, checkpoint: Callable[[Search], None] | None = None) -> Counters:
        numbers, context = iter(range(trees)), self.panel.sparkSession.sparkContext

        def next_tree() -> int | None:
            with self.lock:
                return None if stopped_at is not None and len(self.zoo.members) >= stopped_at else next(numbers, None)

        def work() -> None:
            while (number := next_tree()) is not None:
                context.setLocalProperty("spark.scheduler.pool", f"tree-{number}")
                try:
                    candidates = self.tree(number, budget, most_budget)
                except Exception:  # one tree doesn't end the run
                    log.exception("tree %d was given up", number)
                    with self.lock:
                        self.count.failed += 1
                    continue
                self.review(candidates, checkpoint)
            context.setLocalProperty("spark.scheduler.pool", None)

        if parallel <= 1:
            work()
        else:
            with ThreadPoolExecutor(parallel) as pool:
                for done in [pool.submit(inheritable_thread_target(self.panel.sparkSession)(work)) for _ in range(parallel)]:
                    done.result()
        return self.count


def mine(
    spark: SparkSession, panel: DataFrame, proposer: Proposer, zoo: Zoo, horizon: int, trees: int = 2, budget: int = 3, most_budget: int = 6, seed: int = 7,
    split: Split | None = None, root_tries: int = 3, parallel: int = 1, stopped_at: int | None = None, folder: str | None = None, checkpoint: Callable[[Search], None] | None = None,
) -> Counters:
    """Grow trees, ``parallel`` at a time, and admit what passes the gates into ``zoo``, until it has ``stopped_at`` members.

    Metrics are of the training dates; those held out only enter by how much of the rank IC is left there.
    ``panel`` has fwd; ret1, where it is missing, is the next period's return. ``folder``, which driver and executors
    share: values are kept there, for later steps and runs on the same panel. Members that are in the zoo at
    the start take part like others, so a run goes on from a saved one.
    """
    if "ret1" not in panel.columns:
        panel = panel.withColumn("ret1", forward_return(1))
    panel = panel.persist()
    split = split or Split.at(panel.agg(F.max("date_idx") + 1).first()[0])
    search = Search(panel, proposer, zoo, horizon, split, seed, root_tries, ValueStore(folder, panel, prepared) if folder else None)
    try:
        search.learn()
        return search.run(trees, budget, most_budget, parallel, stopped_at, checkpoint)
    finally:
        panel.unpersist()


def saved(folder: str) -> Callable[[Search], None]:
    """A checkpoint: zoo.json and stats.json in a folder of the driver, replaced as a whole."""

    def checkpoint(search: Search) -> None:
        at = Path(folder)
        at.mkdir(parents=True, exist_ok=True)
        stats = vars(search.count) | {"zoo_size": len(search.zoo.members), "forbidden_subtrees": search.avoid}
        for name, write in (("zoo.json", search.zoo.save), ("stats.json", lambda p: Path(p).write_text(json.dumps(stats, indent=1)))):
            write(str(at / f".{name}"))
            (at / f".{name}").replace(at / name)

    return checkpoint
