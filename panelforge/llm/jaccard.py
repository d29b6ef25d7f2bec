"""N-gram Jaccard join: a size-aware heavy-light set similarity self-join over word shingles.

Small (light) sets enumerate their subsets of the sizes that an overlap with a partner must have; equal
subsets meet. Large (heavy) sets scan inverted lists: those of the first few tokens in an order that puts
rare tokens first, since linked sets must share one of these. The boundary between the two is where the
estimated costs cross. Of the sets that meet at a key, those whose bitmaps don't rule out a link are joined into candidate
groups, in which overlaps are counted exactly by scanning the group's own inverted lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import U64, WordHasher, as_bytes, bit_set, components, grams, grouped, hashed, id_bits, mix, scratch, table, written

#: Sets up to this size may be light; sets of one block of a large candidate group; log2 of the bits of a set's bitmap.
MOST_LIGHT, BLOCK, BITS = 40, 1024, 10

_hasher = WordHasher()


def shingles(text: bytes, k: int) -> np.ndarray:
    """The set of ``k``-word shingles as sorted hashes; of a shorter text, the whole sequence as one."""
    h = _hasher(text.lower().split())
    if not len(h):
        return np.empty(0, U64)
    return np.unique(grams(h, min(k, len(h))) + U64(min(k, len(h))))


def missing(n: int, num: int, den: int) -> int:
    """How many elements of a set of ``n`` a linked set can lack at most: overlap >= num/den * n."""
    return n - -(-num * n // den)


def light_keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the set's subsets of each size that an overlap can have."""
    n, m = len(tokens), mix(tokens)
    total, out = m.sum(dtype=U64, keepdims=True), []
    for j in range(missing(n, num, den) + 1):
        gone = np.array([m[list(c)].sum(dtype=U64) for c in combinations(range(n), j)], U64)
        out.append(mix((total - gone) ^ mix(np.array([n - j], U64))))
    return np.concatenate(out)


def boundary(sizes: dict[int, int], mean_list: float, num: int, den: int) -> int:
    """The size from which sets are heavy: least total of subsets to enumerate and list entries to scan.

    ``sizes``: how many sets have each size up to MOST_LIGHT. Heavy sets small enough to link with a
    light one enumerate subsets as well, which counts.
    """
    light = {n: sum(math.comb(n, j) for j in range(missing(n, num, den) + 1)) for n in range(1, MOST_LIGHT + 1)}
    best = (math.inf, 1)
    for x in range(1, MOST_LIGHT * num // den + 1):
        cost = sum(
            c * ((light[n] if n < x or n * num < x * den else 0) + (0 if n < x else (missing(n, num, den) + 1) * mean_list))
            for n, c in sizes.items()
            if n in light
        )
        best = min(best, (cost, x))
    return best[1]


def bitmap(mixed: np.ndarray) -> bytes:
    """One bit for each of a set's mixed hashes; some have it in common."""
    out = np.zeros(1 << BITS, bool)
    out[mixed >> U64(64 - BITS)] = True
    return np.packbits(out).tobytes()


def may_link(n: np.ndarray, bits: np.ndarray, num: int, den: int, split: int | None = None) -> list[tuple[int, int]]:
    """Pairs of places that connect all those whose sets may be linked, by their sizes and bitmaps (as rows of words).

    A bit that one set alone has stands for an element that the other lacks, and of n + m elements of linked sets no more
    than (den - num) / (den + num) are so. Each place is compared with those that aren't connected yet. ``split``: as in ``overlaps``.
    """
    free, out = np.arange(len(n)), []
    while len(free):
        waiting, free = [free[0]], free[1:]
        while waiting and len(free):
            i = waiting.pop()
            others = free if split is None else free[(free >= split) != (i >= split)]
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64)
            alike = den * np.minimum(n[others], n[i]) >= num * np.maximum(n[others], n[i])
            hit = others[alike & (apart * (den + num) <= (n[others] + n[i]) * (den - num))]
            out += [(int(i), int(j)) for j in hit]
            waiting += hit.tolist()
            free = free[~np.isin(free, hit)] if len(hit) else free
    return out


def overlaps(sets: list[np.ndarray], split: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, its overlap with every later one, counted along inverted lists.

    With ``split``, only pairs of one set before and one from that place on are of interest.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    _, token = np.unique(tokens, return_inverse=True)
    order = np.argsort(token, kind="stable")
    lists, bounds = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
    common = np.diff(bounds) > 1
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for i in range(len(sets) if split is None else split):
        t = token[at[i] : at[i + 1]]
        t = t[common[t]]
        if not len(t):
            continue
        n = bounds[t + 1] - bounds[t]
        j = np.repeat(bounds[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield i, np.bincount(lists[j], minlength=len(sets))


def linked(sets: list[np.ndarray], num: int, den: int, split: int | None = None) -> list[tuple[int, int]]:
    """Pairs of places of sets with den * |intersection| >= num * |union|; within a known component, a few do."""
    size, root, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i, both in overlaps(sets, split):
        hit = np.flatnonzero(den * both >= num * (size + size[i] - both))
        hit = hit[(hit > i) if split is None else (hit >= split)]
        new = hit[root[hit] != root[i]]
        for j in new:
            if root[j] != root[i]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked, over any number of steps, by Jaccard >= num/den.

    ``docs``: doc_id, text; other columns are not read, and clashing names do no harm. Words are split at
    ASCII white space and lower-cased A-Z. Null and empty texts have no shingles and are linked with
    nothing; texts with fewer than ``k`` words count as one shingle. Equal sets are joined before anything
    else, so copies cost one row each. Rows that repeat an id are one document for linking. Rows with a
    null id get the component of their identified copies, else null. Sets are compared by 64-bit shingle hashes.

    The token order needs no count of all shingles: a fixed share of the hash space is counted, and the
    rarest tokens of that share come first in every set. Most documents have more unseen tokens there
    than a linked set could lack, and are done.
    """
    share = int(min(0.99, 1.7 * (1 - num / den)) * 2**63) * 2 - 2**63  # signed: tokens below are counted

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text, k)
                m = mix(s ^ U64(0x5851F42D4C957F2D))
                v = np.sort(s.view(np.int64))
                own, rest = v[v < share], v[v >= share]
                short = missing(len(v), num, den) + 1 - len(own)
                key = (int(m.sum(dtype=U64).view(np.int64)), int(np.bitwise_xor.reduce(m).view(np.int64)) if len(m) else 0)
                out.append((doc, len(v), *key, own, rest[: max(short, 0)], v if len(v) <= MOST_LIGHT else None, bitmap(m)))
            a = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), a, a, a, pa.binary())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], ["doc_id", "n", "d1", "d2", "own", "rest", "small", "bits"]
            )

    with scratch(docs.sparkSession):
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("b"))
        all_sets = written(
            read.mapInArrow(sets, "doc_id long, n long, d1 long, d2 long, own array<long>, rest array<long>, small array<long>, bits binary")
        )
        ids = all_sets.select("doc_id", "n", "d1", "d2")
        reps = ids.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
        first = all_sets.join(reps.select(F.col("rep").alias("doc_id"), "n", "d1", "d2"), ["doc_id", "n", "d1", "d2"], "left_semi").dropDuplicates(
            ["doc_id", "n", "d1", "d2"]
        )
        first = written(first.select(F.xxhash64("doc_id", "d1", "d2").alias("set"), "doc_id", "n", "own", "rest", "small", "bits"))

        entry = first.select("set", F.explode("own").alias("token"))
        counts = written(entry.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
        shared = entry.join(counts, "token").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
        tokens, listed = first.agg(F.sum(F.size("own"))).first()[0] or 0, counts.agg(F.sum("df")).first()[0] or 0
        sizes = {r.n: r["count"] for r in first.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
        x = boundary(sizes, 1 + listed / max(1, tokens), num, den)

        # heavy sets: lists of the rarest tokens; those seen once take up places but have no list
        lack = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")
        heavy = (
            first.where(F.col("n") >= x).join(shared, "set", "left")
            .withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<df:bigint,token:bigint>>")))
            .withColumn("need", (lack - (F.size("own") - F.size("shared"))).cast("int"))
            .where("need > 0")
            .select("set", "doc_id", F.explode(F.concat(
                F.transform(F.slice("shared", F.lit(1), F.col("need")), lambda s: s["token"]),
                F.slice("rest", F.lit(1), F.greatest(F.lit(0), F.col("need") - F.size("shared")).cast("int")),
            )).alias("key"))
        )

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, doc, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    own = light_keys(np.asarray(v, np.int64).view(U64), num, den).view(np.int64)
                    yield pa.record_batch([pa.array([name] * len(own)), pa.array([doc] * len(own)), pa.array(own)], ["set", "doc_id", "key"])

        light = first.where(F.col("n") * num < F.lit(x * den)).select("set", "doc_id", "small").mapInArrow(keys, "set long, doc_id long, key long")
        met = written(heavy.withColumn("kind", F.lit(0)).unionByName(light.withColumn("kind", F.lit(1))))
        groups = written(components(_candidates(met, first, num, den)))

        links = written(_verified(read, first, groups, k, num, den))
        # ``whole``: found in one place, so that the smallest id is already known
        found = links.where("whole").select("doc_id", "root")
        parts = links.where("not whole").select(F.col("root").alias("a"), F.col("doc_id").alias("b"))
        if not parts.isEmpty():
            found = found.unionByName(components(parts).select(F.col("node").alias("doc_id"), "root"))
        found = found.groupBy("doc_id").agg(F.min("root").alias("root"))
        return written(
            ids.join(reps, ["n", "d1", "d2"], "left").join(found.withColumnRenamed("doc_id", "rep"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id")),
            result=True,
        )


def _units(member: DataFrame, num: int, den: int, *kept: str) -> DataFrame:
    """Units of work (kept columns, unit, side, whole) for all pairs of ``member`` (grp, n, doc_id, ...) within their groups.

    A group of at most BLOCK sets is one unit of work. A larger one is cut by size class, as sets of
    distant sizes can't be linked, and by hash into blocks; each pair of blocks of the same or adjacent
    classes is a unit, so that no task holds more than two blocks.
    """
    member = member.withColumn("class", F.floor(F.log("n") / F.lit(1.000001 * math.log(den / num) if num < den else 1.0)))
    by_class = member.groupBy("grp", "class").agg(F.count("*").alias("m"))
    size = by_class.groupBy("grp").agg(F.sum("m").alias("size"))
    cut = written(by_class.join(size, "grp").withColumn("chunks", F.when(F.col("size") <= BLOCK, 0).otherwise(F.ceil(F.col("m") / F.lit(BLOCK)))))
    member = written(
        member.join(cut.drop("m", "size"), ["grp", "class"]).withColumn("chunk", F.when(F.col("chunks") > 0, F.pmod(F.xxhash64("doc_id", F.lit(7)), "chunks")))
        .select(*kept, "grp", F.when(F.col("chunks") > 0, F.col("class")).alias("class"), "chunk")
    )
    block = cut.where("chunks > 0").select("grp", "class", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    other = block.select("grp", F.col("class").alias("class2"), F.col("chunk").alias("chunk2"))
    near = F.expr("(class2 = class and chunk2 >= chunk) or class2 = class + 1")
    pair = block.join(other, "grp").where(near).withColumn("unit", F.xxhash64("grp", "class", "chunk", "class2", "chunk2"))
    sides = pair.select("grp", "class", "chunk", "unit", F.lit(0).alias("side")).unionByName(
        pair.where("class2 <> class or chunk2 <> chunk").select("grp", F.col("class2").alias("class"), F.col("chunk2").alias("chunk"), "unit", F.lit(1).alias("side"))
    )
    return (
        member.where("chunk is null").select(*kept, F.xxhash64("grp").alias("unit"), F.lit(0).alias("side"), F.lit(True).alias("whole"))
        .unionByName(member.where("chunk is not null").join(sides, ["grp", "class", "chunk"]).select(*kept, "unit", "side", F.lit(False).alias("whole")))
    )


def _candidates(met: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between sets that meet at a key (kind, key, set) and whose bitmaps don't rule out a link.

    A shingle that many texts say by chance connects none of them so, however long its list. Keys at which the same sets meet count once.
    """
    own = (F.bit_xor(F.xxhash64(F.lit(i), "set")).alias(f"x{i}") for i in range(2))
    lists = met.groupBy("kind", "key").agg(F.count("*").alias("m"), F.min("set").alias("a"), F.max("set").alias("z"), *own).where("a <> z")
    lists = written(lists.groupBy("m", "x0", "x1").agg(F.min(F.struct("kind", "key")).alias("at")).select("at.kind", "at.key"))
    member = met.join(lists, ["kind", "key"]).select(F.xxhash64("kind", "key").alias("grp"), "set", "doc_id")
    work = _units(member.join(first.select("set", "n"), "set"), num, den, "set")

    def connected(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by("side")
        name, side, n = (t.column(c).to_numpy() for c in ("set", "side", "n"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), U64).reshape(len(n), -1)
        pairs = may_link(n, bits, num, den, int((side == 0).sum()) if side.any() else None)
        if pairs:
            i, j = np.array(pairs).T
            yield pa.record_batch([pa.array(name[i]), pa.array(name[j])], ["a", "b"])

    rows = work.drop("whole").join(first.select("set", "n", "bits"), "set")
    return written(grouped(rows, ["unit"], "a long, b long", connected))


def _verified(read: DataFrame, first: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (doc_id, root, whole) inside the candidate groups (node: set, root)."""
    spark = read.sparkSession
    member = written(first.select("set", "doc_id", "n").join(groups.select(F.col("node").alias("set"), F.col("root").alias("grp")), "set"))
    work = _units(member, num, den, "set", "doc_id")
    bits = spark.sparkContext.broadcast(id_bits(member, "doc_id"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(bit_set(bits.value, b.column(2).to_numpy(zero_copy_only=False)))) if b.num_rows else b
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text, k)
                m = mix(s ^ U64(0x5851F42D4C957F2D))
                if len(s):
                    out.append((doc, int(m.sum(dtype=U64).view(np.int64)), int(np.bitwise_xor.reduce(m).view(np.int64)), s.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], ["doc_id", "d1", "d2", "tokens"])

    held = read.where("doc_id is not null").withColumn("h", hashed("doc_id")).mapInArrow(again, "doc_id long, d1 long, d2 long, tokens binary")
    held = held.select(F.xxhash64("doc_id", "d1", "d2").alias("set"), "tokens").join(member.select("set"), "set", "left_semi").dropDuplicates(["set"])

    def verify(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by([("side", "ascending"), ("doc_id", "ascending")])
        doc, side = t.column("doc_id").to_numpy(), t.column("side").to_numpy()
        sets = [np.frombuffer(x, U64) for x in t.column("tokens").to_pylist()]
        pairs = linked(sets, num, den, int((side == 0).sum()) if side.any() else None)
        if pairs:
            root = np.arange(len(doc))
            for i, j in pairs:
                a, z = sorted((root[i], root[j]))
                root[root == z] = a
            # with the sides sorted by id, the smallest id of a class is its smallest on either side
            low = np.full(len(doc), np.iinfo(np.int64).max)
            np.minimum.at(low, root, doc)
            yield pa.record_batch(
                [pa.array(doc), pa.array(low[root]), pa.array([t.column("whole")[0].as_py()] * len(doc))], ["doc_id", "root", "whole"]
            )

    return grouped(work.join(held, "set").drop("set"), ["unit"], "doc_id long, root long, whole boolean", verify)


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))
