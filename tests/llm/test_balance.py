import math
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from panelforge.llm.balance import balanced_documents, mixed, op12_mixture, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_of(sizes: dict) -> dict:
    """Shares by weight, and what is above three times a size given to the others, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: Fraction(weight[s] * left, sum(weight[t] for t in order if t not in capped)) for s in order if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in order}
        capped.add(min(over, key=lambda s: Fraction(3 * sizes[s], weight[s])))


def tilted(sizes: list[int], target: float) -> dict[int, float]:
    """The rate of each size where the tilted rates give the target, by bisection."""
    scale = max(sum(sizes), 1) / len(sizes)
    rate = lambda t, n: 3 / (1 + 2 * math.exp(min(700.0, -t * n / scale)))
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * rate(mid, n) for n in sizes) < target else (low, mid)
    return {n: rate(low, n) for n in set(sizes)}


def checked(got, docs):
    """``got``: the operator's rows; ``docs``: (doc_id, text, source)."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    of_source: dict = {}
    for d, _, s in docs:
        of_source.setdefault(s, []).append(d)
    targets = targets_of({s: sum(size[d] for d in ids) for s, ids in of_source.items()})
    rows = {r.doc_id: r for r in got}
    assert len(got) == len(rows) == len(docs)
    for s, ids in of_source.items():
        total = sum(size[d] for d in ids)
        rates = tilted([size[d] for d in ids], float(targets[s])) if 0 < targets[s] < 3 * total else None
        for d in ids:
            r = rows[d]
            assert (r.size, r.source_size) == (size[d], total) and r.target == pytest.approx(float(targets[s]), rel=1e-9)
            assert r.copies * r.size <= 3 * r.size and abs(r.copies - r.rate) < 1
            if rates:
                assert r.rate == pytest.approx(rates[size[d]], abs=1e-4)
            elif total:
                assert r.rate == 3 and r.copies == 3
        taken = sum(rows[d].copies * size[d] for d in ids)
        assert abs(taken - targets[s]) <= 1.5 * max((size[d] for d in ids), default=0) + 1, s


def test_whole_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    out = op12_mixture(spark, "/root/testdata/sf0.01")
    got = out.collect()
    assert all(r.taken == r.copies * r.size for r in got)
    checked(got, docs)
    assert sorted(op12_mixture(spark, "/root/testdata/sf0.01").collect()) == sorted(got)  # reruns agree


def test_a_small_source_stops_at_three_times_its_size_and_the_others_share(spark):
    docs = [(i, "w " * (1 + i % 50), "a" if i < 3 else "b" if i < 200 else None) for i in range(400)]
    checked(balanced_documents(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect(), docs)


@pytest.mark.parametrize("sizes", [{"a": 0, "b": 0}, {"a": 5}, {"a": 10, "b": 10, "c": 10, "d": 1000, None: 3}, {"z": 1, "é": 700, "Z": 40, "": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = targets_of(sizes)
    assert got == {s: pytest.approx(float(v), abs=1e-9) for s, v in want.items()}


def test_a_hot_size_is_cut_into_buckets_and_counts_stay_exact(spark):
    items = spark.range(30_000).select("id", F.lit("s").alias("source"), F.when(F.col("id") < 25_000, 7).otherwise(F.col("id") % 90).cast("long").alias("size"), F.xxhash64("id").alias("h"))
    items = items.unionByName(spark.range(30_000, 60_000).select("id", F.lit("t").alias("source"), F.lit(20).cast("long").alias("size"), F.xxhash64("id").alias("h")))
    got = mixed(items, weights=(1, 3))
    sums = got.groupBy("source_size").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(sums) == 2 and all(abs(r.taken - r.target) <= 100 for r in sums)
    one = got.where("size = 7").agg(F.sum("copies"), F.sum("rate"), F.max("copies") - F.min("copies")).first()
    assert abs(one[0] - one[1]) <= 1 and one[2] <= 1


def test_odd_rows(odd, empty):
    got = balanced_documents(odd).collect()
    rows = odd.select("doc_id", "text", "source").collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r.doc_id or -1, len(WORD.findall(r.text or ""))) for r in rows)
    assert balanced_documents(empty).count() == 0
