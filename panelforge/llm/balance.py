"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and the most copies allowed. Of all rates that give every source its target
of words, those are taken that differ least from one copy each, by the entropy of a bounded variable; they are
exponential tilts in the document's size, rate / (most - rate) = exp(tilt * size / mean size) / (most - 1), with one tilt
a source: the dual variables of the word constraints, a convex problem that Newton's method solves. A rate depends
on source and size only, so the sums of an iteration run over the histogram of sizes, which Spark adds up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import joined, running, scratch, table, written

#: Weights of the sources in their order, again and again; copies of a document, at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Rates are multiples of 1 / ONE, so that sums over them are exact and reruns agree in any order of adding up.
ONE = 1 << 20
#: Newton iterations, at most; share of the target that may be missed by rates; rows of a bucket within which copies are ranked.
ROUNDS, NEAR, BUCKET_ROWS = 200, 1e-7, 4_096


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size; one row each, nulls last in order) with target: their share of all sizes by weight.

    No target exceeds ``most`` times its source's size; the excess goes to the others by weight. The level of words
    per weight only rises from round to round, and each round is one aggregation.
    """
    placed = running(sources, [F.col("source").asc_nulls_last()], F.lit(1).cast("long"), "__at")
    of = F.element_at(F.array(*map(F.lit, weights)), (F.col("__at") % len(weights) + 1).cast("int"))
    weighed = written(placed.withColumn("__w", of).drop("__at"))
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * float(most)
    level, known = 0.0, None
    while True:
        full = F.col("__w") * F.lit(level) > limit
        now = weighed.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("__w")))).first()
        if now == known or not now[1]:
            break
        known, level = now, max(level, (total - now[0]) / now[1])
    return weighed.withColumn("target", F.least(F.col("__w") * F.lit(level), limit)).drop("__w")


def _rate(most: int) -> Column:
    """The tilted rate of a size, in units of 1 / ONE."""
    return F.rint(most * ONE / (1 + (most - 1) * F.exp(-F.col("tilt") * F.col("size") / F.col("scale")))).cast("long")


def tilts(cells: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """k, tilt, scale of each source: where its rates give its target.

    ``cells``: k, size, n (documents of it); ``sources``: k, source_size, docs, n (cells of it), target; both stored.
    Targets at the limits have infinite tilts. Newton steps are kept within the bracket that earlier steps
    have left; sums are exact decimals, so the path is the same in each run.
    """
    total, inf = cells.count(), float("inf")
    limit = F.col("source_size") * float(most)
    ends = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= limit * (1 - 1e-12), inf).when(F.col("target") <= 0, -inf)
    state = sources.select(
        "k", "n", "target", (F.greatest("source_size", F.lit(1)) / F.col("docs")).alias("scale"), F.coalesce(ends, F.lit(0.0)).alias("tilt"),
        F.lit(-inf).alias("low"), F.lit(inf).alias("high"), ends.isNotNull().alias("done"),
    )
    state = written(state)
    words = F.col("rows").cast("decimal(20,0)") * F.col("size").cast("decimal(18,0)")
    rate = F.col("rate") / ONE
    for _ in range(ROUNDS):
        if state.where("not done").isEmpty():
            break
        met = joined(cells.withColumnRenamed("n", "rows"), state.where("not done"), ["k"], "n", total).withColumn("rate", _rate(most))
        bend = F.col("rows") * F.col("size") * (F.col("size") / F.col("scale")) * rate * (most - rate) / most
        sums = met.groupBy("k").agg(
            (F.sum((words * F.col("rate")).cast("decimal(38,0)")) / ONE).cast("double").alias("got"),
            (F.sum(F.rint(bend * 1024).cast("decimal(38,0)")) / 1024).cast("double").alias("bend"),
        )
        off = F.col("target") - F.col("got")
        low, high = F.when(off > 0, F.col("tilt")).otherwise(F.col("low")), F.when(off > 0, F.col("high")).otherwise(F.col("tilt"))
        reach = 4 * (1 + F.abs("tilt"))
        step = F.coalesce(F.try_divide(off, F.col("bend")), F.signum(off) * reach)
        step = F.greatest(-reach, F.least(reach, step))
        close = (F.abs(off) <= F.col("target") * NEAR) | (F.col("high") - F.col("low") <= 1e-13 * (1 + F.abs("tilt")))
        moved = (
            state.where("not done").join(sums, "k")
            .withColumns({"low": low, "high": high, "next": F.col("tilt") + step, "close": close})
            .withColumn("next", F.when((F.col("next") > F.col("low")) & (F.col("next") < F.col("high")), F.col("next")).otherwise((F.col("low") + F.col("high")) / 2))
            .select("k", "n", "target", "scale", F.when(F.col("close"), F.col("tilt")).otherwise(F.col("next")).alias("tilt"), "low", "high", F.col("close").alias("done"))
        )
        state = written(moved.unionByName(state.where("done")))
    else:
        raise RuntimeError(f"tilts aren't found after {ROUNDS} rounds")
    return state.select("k", "tilt", "scale")


def mixed(items: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``items`` (id, source, size, h) with source_size, target, rate and copies.

    A rate becomes its whole part in copies, and one more for so many documents as the sum of its fractions asks for:
    cells of source and size, cut into buckets of a few thousand documents, stand in order, and each gets the whole
    numbers that the running sum of fractions passes in it, so a source's words miss its target by little more than
    one document. Within a bucket the documents of least ``h`` get them. ``h`` is any hash that is the same in each run; rows
    that agree in it and id are taken to be equal. Sources without words have a target of 0 and rates of one.
    """
    k = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))
    with scratch(items.sparkSession):
        docs = written(items.select("id", k.alias("k"), "source", "size", "h"))
        cells = written(docs.groupBy("k", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")))
        sources = cells.groupBy("k").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.count("*").alias("n"))
        sources = written(source_targets(sources, weights, most))
        known = written(sources.join(tilts(cells, sources, most), "k").select("k", "source_size", "target", "tilt", "scale", "n"))
        rated = joined(cells.select("k", "size", F.col("n").alias("rows")), known, ["k"], "n", cells.count())
        flat = F.when(F.abs("tilt") == float("inf"), F.when(F.col("tilt") > 0, most * ONE).otherwise(0)).otherwise(_rate(most))
        rated = written(rated.select("k", "size", "source_size", "target", flat.cast("long").alias("rate"), F.col("rows").alias("n"), F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets")))
        dealt = joined(docs.drop("source"), rated, ["k", "size"], "n", docs.count()).withColumn("bucket", F.pmod("h", "buckets")).drop("buckets")
        dealt = written(dealt.withColumn("rate", F.col("rate")))
        spare = F.col("rate") % ONE
        key = ["k", "size", "bucket"]
        buckets = dealt.groupBy(*key).agg(F.sum(spare).alias("v"))
        passed = running(buckets, [F.col(c) for c in key], F.col("v"), "before")
        whole = lambda x: F.shiftright(x + ONE // 2, 20)
        extra = written(passed.select(*key, (whole(F.col("before") + F.col("v")) - whole(F.col("before"))).alias("extra")))
        place = F.row_number().over(Window.partitionBy(*key).orderBy("h", "id"))
        copies = F.shiftright("rate", 20) + (F.col("place") <= F.col("extra")).cast("long")
        out = dealt.withColumn("place", place).join(extra, key)
        return written(out.select("id", "size", "source_size", "target", (F.col("rate") / ONE).alias("rate"), copies.alias("copies")), result=True)


def balanced_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size (words), source_size, target (words of its source in the mix), rate, copies of each document.

    Null texts have size 0, and so have those of nothing but space; documents without source are a source of their own. Repeated
    rows are documents like others; an empty table gives none; other columns aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return mixed(docs.select(F.col("doc_id").alias("id"), "source", size.alias("size"), F.xxhash64("doc_id", text).alias("h")), weights, most).withColumnRenamed("id", "doc_id")


def op12_mixture(spark, sf_dir: str) -> DataFrame:
    out = balanced_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
