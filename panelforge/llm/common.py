"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named input table, with only the given columns if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the context's own.

    Without either, a temporary folder is taken in local mode, where one machine does all the work; on a
    cluster that would be another folder on each machine, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelforge-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


_scratch: ContextVar[list[list[str]]] = ContextVar("scratch", default=[])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at its end, but for those written with ``result``: these are left to what is around it."""
    held: list[str] = []
    before = _scratch.set([*_scratch.get(), held])
    try:
        yield
    finally:
        _scratch.reset(before)
        for path in held:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, result: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that its lineage ends there. See ``scratch``."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    around = _scratch.get()[: -1 if result else None]
    if around:
        around[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def as_bytes(column: str = "text"):
    """The column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class WordHasher:
    """64-bit hashes of words, remembered for a bounded number of distinct words."""

    def __init__(self, most: int = 300_000):
        self.most, self.seen = most, {}

    def __call__(self, words: list) -> np.ndarray:
        import xxhash

        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, words), U64, len(words))
        except KeyError:
            one = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in seen:
                    seen[w] = one(w)
            return np.fromiter(map(seen.__getitem__, words), U64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` consecutive items at each place of ``h`` (in order, with repeats)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * U64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def id_bits(df: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A bitmap over hashed values of ``column``: 2^bits bits, whatever the number of rows.

    A set bit may belong to another value, so it only thins out rows ahead of an exact join.
    """
    h = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    rows = (
        df.select((h + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("n"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("b")).collect()
    )
    out = np.zeros((1 << bits) // 8 + 4096, np.uint8)
    for r in rows:  # buckets count from 1 and hold 4096 bytes
        out[(r.n - 1) * 4096 : r.n * 4096] = np.frombuffer(bytes(r.b), np.uint8)
    return out


def bit_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashed values ``h`` (column ``hashed``) have their bit set."""
    return (bits[h >> 3] >> (h & 7)) & 1 == 1


def hashed(column: str, bits: int = 24):
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def grouped(df: DataFrame, keys: list[str], schema: str, run) -> DataFrame:
    """Apply ``run(table) -> iterator of record batches`` to the rows of each key, one key in memory at a time.

    Like applyInArrow, but without its cost for each of very many small groups: rows are dealt by key,
    sorted, and cut where the key changes as the batches stream by.
    """
    names = df.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for k in keys:
                v = b.column(names.index(k)).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                now = tuple(b.column(names.index(k))[i].as_py() for k in keys)
                if held and now != last:
                    yield from run(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(i, j - i))
                last = now
        if held:
            yield from run(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(go, schema)


def running(df: DataFrame, order: Sequence[Column], column: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``column`` over the rows before, in the order of all: a written table.

    Sorted ranges are summed one by one; only a sum for each range passes through the driver.
    """
    dealt = written(df.withColumn("__v", column).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = {r.p: r.v for r in dealt.groupBy(F.col("__part").alias("p")).agg(F.sum("__v").alias("v")).collect()}
    starts, at = [], 0
    for p in sorted(sums):
        starts.append((p, at))
        at += sums[p]
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __from long"))
    upto = F.sum("__v").over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", upto).join(before, "__part").withColumn(name, F.col("__from") + F.col("__own") - F.col("__v")).drop("__part", "__from", "__own", "__v")


#: A key is hot if it has more than this part of all rows; so there are fewer than 512 hot keys, whatever the input.
HOT = 1 / 512


def joined(big: DataFrame, small: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``small``, one row a key, whose column ``n`` says how many rows ``big`` has of it.

    Rows of hot keys stay where they are and get their partner from a broadcast table of fewer than 1 / HOT
    rows; only the others move. ``total``: the rows of ``big``. Both are stored tables, as they are read more than once.
    """
    hot = F.col(n) > F.lit(HOT * total)
    few = small.where(hot).collect()
    if not few:
        return big.join(small.drop(n), keys)
    held = big.sparkSession.createDataFrame(few, small.schema).drop(n)
    if len(keys) == 1:
        rest = big.where(~F.col(keys[0]).isin([r[keys[0]] for r in few]))
    else:
        rest = big.join(F.broadcast(held.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(held), keys).unionByName(rest.join(small.where(~hot).drop(n), keys))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps, which keep the edges linear in the input and need a
    logarithmic number of rounds. Each step groups by node, so a hub's neighbours are only ever folded
    into a minimum, and rows of a hub are not gathered for the join; every round ends in a written table.
    Nothing is collected but a few numbers a round. Edges with a null end or equal ends are ignored. It is
    an error if the rounds run out before nothing changes.
    """
    with scratch(edges.sparkSession):
        e = written(
            edges.where("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .distinct()
        )
        known, m = None, e.count()
        for _ in range(most_rounds):
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
            large = written(  # every larger neighbour now points to the smallest one
                joined(e.select(F.col("v").alias("u"), F.col("u").alias("w")), low, ["u"], "n", m).select(F.col("w").alias("u"), F.col("m").alias("v"))
                .where("u <> v").distinct()
            )
            low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
            small = joined(large, low, ["u"], "n", m)
            e = written(
                small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
            )
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == known:
                break
            known, m = now, max(m, now[0])
        else:
            raise RuntimeError(f"components aren't settled after {most_rounds} rounds")
        # at the fixed point every node has one edge, to its root
        stars = e.groupBy("u").agg(F.min("v").alias("root"))
        own = stars.select(F.col("root").alias("node"), "root").distinct()
        return written(stars.select(F.col("u").alias("node"), "root").unionByName(own), result=True)


def _flagged(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``df`` with __maybe: whether ``column`` may be among ``wanted.id``, by a bitmap of 2^24 bits.

    The bitmap has 512 rows of 512 longs, however many ids there are, so it can be broadcast.
    """

    def parts(c: Column) -> tuple[Column, Column, Column]:
        h = F.pmod(F.xxhash64(c), F.lit(1 << 24))
        return F.shiftright(h, 15).cast("int"), F.shiftright(h, 6).bitwiseAND(F.lit(511)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")

    b, w, p = parts(F.col("id").cast("long"))
    words = wanted.select(b.alias("__b"), w.alias("w"), p.alias("p")).select("__b", "w", F.expr("shiftleft(1L, p)").alias("v"))
    i = F.col("id")
    none = wanted.sparkSession.range(1 << 18).select(F.shiftright(i, 9).cast("int").alias("__b"), i.bitwiseAND(F.lit(511)).cast("int").alias("w"), F.lit(0).cast("long").alias("v"))
    bits = (  # every word of the bitmap, in order
        words.unionByName(none).groupBy("__b", "w").agg(F.bit_or("v").alias("v"))
        .groupBy("__b").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("__bits"))
    )
    b, w, p = parts(F.col(column).cast("long"))
    met = df.withColumns({"__b": b, "__w": w, "__p": p}).join(F.broadcast(bits), "__b", "left")
    return met.withColumn("__maybe", F.coalesce(F.expr("bit_get(__bits[__w], __p) = 1"), F.lit(False))).drop("__b", "__w", "__p", "__bits")


def thinned(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the ids of ``wanted`` (column id), ahead of an exact join."""
    return _flagged(df, column, wanted).where("__maybe").drop("__maybe")


def parted(df: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` may be among ``wanted.id``, rows that surely aren't), so that only the first need moving."""
    f = _flagged(df, column, wanted)
    return f.where("__maybe").drop("__maybe"), f.where("not __maybe").drop("__maybe")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids.id``; rows with a null id stay. Other rows' texts aren't shuffled."""
    ids = written(ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct())
    maybe, rest = parted(docs, "doc_id", ids)
    gone = ids.withColumnRenamed("id", "__id")
    return maybe.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left_anti").unionByName(rest)
