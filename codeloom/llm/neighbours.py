"""The k most similar vectors of every vector.

Method: multiprobe p-stable hashing. Each table cuts the unit sphere into buckets by
floor((a.x + b) / w) with Gaussian a; a vector visits its own bucket and perturbed ones in the
order of their estimated success (expected squared distance to the slot boundaries), the
candidates of all tables are reranked by exact cosine, and vectors whose neighbours turn out
to be far visit further buckets.

Exact copies are folded into one representative first, so a group of copies costs nothing.
Buckets are large and visited few times, since a vector that travels to a bucket costs more
than a hundred inner products there; those holding too many members are cut into blocks of
fixed size, each block of members meeting each block of visitors, so no task holds an
unbounded group and no pair of a bucket is dropped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.keys import plain_key
from codeloom.operators.skew import HOT_PARTS, hot_keys, lookup_join
from codeloom.runtime import Scratch

WIDTH = 1.0  # slot width w on unit vectors
TABLES = 3
OCCUPANCY = 512  # members aimed at in an average bucket; sets the number of hash functions
MORE = 2  # times as many probes for vectors whose neighbours are far
MEMBERS, VISITORS = 4096, 16384  # members and visitors of a bucket in one block
SEED = 20240229


def usable_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """(id, vec) of the row built last per id, without vectors that are null, of another length, all zero or not finite.

    Of equal build times the larger hash, then vector, holds. Rows without id are left out.
    """
    last = rows.select(plain_key(F.col("id")).alias("id"), "built_at", "hash", "vec").where("id is not null")
    last = last.groupBy("id").agg(F.max(F.struct("built_at", "hash", F.coalesce("vec", F.array().cast("array<float>")).alias("vec"))).alias("m")).select("id", F.col("m.vec").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e30))) & F.exists("vec", lambda x: x != 0)
    return last.where((F.size("vec") == dim) & fine)


def _templates(m: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of boundary ranks in the order of their expected score; the empty set (own bucket) first."""
    z = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    z += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    top = min(2 * m, 4 + math.ceil(math.sqrt(probes)) * 2)
    sets = [(0.0, ())]
    for r in range(1, min(m, 4) + 1):
        for c in itertools.combinations(range(top), r):
            if all(2 * m - 1 - a not in c for a in c):  # one coordinate isn't moved both ways
                sets.append((sum(z[a] for a in c), c))
    sets.sort()
    return [c for _, c in sets[:probes]]


def _codes(slots: np.ndarray) -> np.ndarray:
    h = np.full(len(slots), 1469598103934665603, dtype=np.uint64)
    for j in range(slots.shape[1]):
        h = (h ^ slots[:, j].astype(np.int64).astype(np.uint64)) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def _hasher(dim: int, m: int, probes: int, tables: int, width: float):
    rng = np.random.default_rng(SEED)
    coarse = [(rng.normal(size=(dim, m)), rng.uniform(size=m)) for _ in range(tables)]
    sets = _templates(m, probes)

    def visit(x: np.ndarray, ab, w: float) -> np.ndarray:
        p = x @ ab[0] / w + ab[1]
        own = np.floor(p)
        part = p - own
        order = np.argsort(np.concatenate([part**2, (1 - part) ** 2], axis=1), axis=1, kind="stable")
        at = np.arange(len(x))
        out = np.empty((len(x), len(sets)), dtype=np.int64)
        for i, ranks in enumerate(sets):
            slots = own.copy()
            for r in ranks:
                o = order[:, r]
                slots[at, o % m] += np.where(o < m, -1, 1)
            out[:, i] = _codes(slots)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _unit(batch["raw"], dim)
                codes = np.concatenate([visit(x, ab, width) ^ np.int64(t * 0x9E3779B97F4A7C1) for t, ab in enumerate(coarse)], axis=1)
                yield pd.DataFrame({"rid": batch["rid"], "raw": batch["raw"], "codes": list(codes)})

    return run


def _unit(raw: pd.Series, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(len(raw), dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rerank(dim: int, k: int):
    """The k best members of each visitor that reach its `least` (members have none), cell by cell of rows sorted by cell; a cell that a batch cuts off waits for the next."""

    def meet(rows: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
        x = _unit(rows["raw"], dim)
        rid, least = rows["rid"].to_numpy(), rows["least"].to_numpy()
        member = np.isnan(least)
        out = []
        for a, b in zip(starts, starts[1:]):
            mi, qi = a + np.flatnonzero(member[a:b]), a + np.flatnonzero(~member[a:b])
            if not len(mi) or not len(qi):
                continue
            for s in range(0, len(qi), 1024):
                q = qi[s : s + 1024]
                sim = x[q] @ x[mi].T
                sim[rid[q][:, None] == rid[mi][None, :]] = -9
                n = min(k, len(mi))
                best = np.argpartition(sim, len(mi) - n, axis=1)[:, len(mi) - n :]
                val = np.take_along_axis(sim, best, axis=1).ravel()
                keep = (val > -5) & (val >= np.repeat(least[q], n) - 1e-9)
                out.append((np.repeat(rid[q], n)[keep], rid[mi][best].ravel()[keep], np.round(val[keep], 9)))
        if out:
            r, c, v = (np.concatenate(z) for z in zip(*out))
            yield pd.DataFrame({"rid": r, "nid": c, "cos": v})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            cell = batch["cell"].to_numpy()
            if kept and kept[-1]["cell"].iloc[-1] == cell[0] == cell[-1]:
                kept.append(batch)
                continue
            rows = pd.concat([*kept, batch], ignore_index=True) if kept else batch
            cell = rows["cell"].to_numpy()
            starts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()]
            if len(starts) > 1:
                yield from meet(rows.iloc[: starts[-1]], starts)
            kept = [rows.iloc[starts[-1] :]]
        if kept:
            rows = pd.concat(kept, ignore_index=True)
            yield from meet(rows, [0, len(rows)])

    return run


def nearest_vectors(vectors: DataFrame, k: int = 5, dim: int = 64, probes: int | None = None, tables: int = TABLES, width: float = WIDTH) -> DataFrame:
    """(id, near_id, cos): the k most similar other vectors of every row of vectors(id, vec), by cosine, ties by id.

    vec must be usable (see usable_vectors). Equal vectors are neighbours with cosine 1. With
    k or fewer rows each has all the others. No rows give no rows.
    """
    spark: SparkSession = vectors.sparkSession
    tmp = Scratch(spark, "neighbours")
    pack = F.pandas_udf(lambda s: pd.Series([np.asarray(v, dtype=np.float32).tobytes() for v in s]), "binary")
    packed = vectors.select("id", pack(F.col("vec").cast("array<float>")).alias("raw"))
    ids = tmp.save(packed.withColumn("h", F.xxhash64("raw")), "ids")
    # exact copies: one representative each, with the k + 1 smallest ids of its copies
    firsts = ids.groupBy("h", "raw").agg(F.min("id").alias("rep"))
    reps = tmp.save(firsts.select("rep", "h", "raw", F.monotonically_increasing_id().alias("rid")), "reps")
    hot = hot_keys(ids, "h")
    owner = reps.select("h", F.col("raw").alias("raw2"), "rid")
    is_hot = F.col("h").isin(hot)
    member = ids.where(~is_hot).join(owner.where(~is_hot), "h").unionByName(ids.where(is_hot).join(F.broadcast(owner.where(is_hot)), "h")) if hot else ids.join(owner, "h")
    kept = tmp.save(member.where("raw = raw2").select("id", "rid"), "members")
    few = kept.withColumn("n", F.row_number().over(W.partitionBy("rid").orderBy("id"))).where(F.col("n") <= k + 1)
    few = tmp.save(few.groupBy("rid").agg(F.array_sort(F.collect_list("id")).alias("copies")), "copies")

    n = reps.count()
    m = max(2, round(math.log2(max(n, 1) / OCCUPANCY + 1) / 2.25))
    first = len(_templates(m, probes or m + 1))  # few hash functions have fewer perturbations
    every = len(_templates(m, first * MORE))
    schema = "rid long, raw binary, codes array<long>"  # codes: for each table the own bucket, then the perturbed ones
    hashed = tmp.save(reps.select("rid", "raw").mapInPandas(_hasher(dim, m, every, tables, width), schema), "hashed")

    def codes(a: int, b: int):
        """The a-th to b-th bucket of each table."""
        return F.filter("codes", lambda c, i: (i % every >= a) & (i % every < b))

    members = hashed.select("rid", "raw", F.explode(codes(0, 1)).alias("bucket"))
    found = tmp.save(_best(_search(members, hashed.select("rid", "raw", F.lit(-2.0).alias("least"), F.explode(codes(0, 1)).alias("bucket")), k, dim, tmp), k), "own")
    # other buckets only give what beats the k-th neighbour so far
    asked = hashed.join(_kth(found, k), "rid", "left").fillna(-2.0, ["least"])
    more = _search(members, asked.select("rid", "raw", "least", F.explode(codes(1, first)).alias("bucket")), k, dim, tmp)
    found = tmp.save(_best(found.unionByName(more), k), "found")
    # far or missing neighbours are the ones that hashing misses: such vectors visit more buckets
    far = 1 - (0.6 * width) ** 2 / 2
    unsure = tmp.save(hashed.join(_kth(found, k), "rid", "left").fillna(-2.0, ["least"]).where(F.col("least") < far), "unsure")
    last = "found"
    if every > first and not unsure.isEmpty():
        more = _search(members, unsure.select("rid", "raw", "least", F.explode(codes(first, every)).alias("bucket")), k, dim, tmp)
        found, last = tmp.save(_best(found.unionByName(more), k), "found2"), "found2"
    members = kept
    tmp.keep_only("members", "copies", last)
    # back from representatives to rows: copies of the neighbours and of the vector itself
    wide = found.join(few.withColumnRenamed("rid", "nid"), "nid").select("rid", F.struct(F.negative("cos").alias("d"), "copies").alias("x")).groupBy("rid").agg(F.collect_list("x").alias("xs"))
    cands = few.join(wide, "rid", "left").select("rid", F.concat(F.transform("copies", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("i"))), F.coalesce(F.flatten(F.transform("xs", lambda x: F.transform(x["copies"], lambda i: F.struct(x["d"].alias("d"), i.alias("i"))))), F.array().cast("array<struct<d:double,i:string>>"))).alias("all"))
    cands = cands.select("rid", F.slice(F.array_sort(F.array_distinct("all")), 1, k + 1).alias("best"))
    rows = lookup_join(members, cands, "rid", hot_keys(members, "rid"))
    rows = rows.select("id", F.explode(F.slice(F.filter("best", lambda x: x["i"] != F.col("id")), 1, k)).alias("x"))
    return rows.select("id", F.col("x.i").alias("near_id"), F.negative("x.d").alias("cos"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each rid; a rid has at most k per bucket it visited."""
    top = pairs.groupBy("rid").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.negative("cos").alias("d"), "nid"))), 1, k).alias("b"))
    return top.select("rid", F.explode("b").alias("x")).select("rid", F.col("x.nid").alias("nid"), F.negative("x.d").alias("cos"))


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(rid, least): cosine of the k-th neighbour of the rids that have k."""
    return found.groupBy("rid").agg(F.count(F.lit(1)).alias("c"), F.min("cos").alias("least")).where(F.col("c") >= k).select("rid", "least")


def _search(members: DataFrame, visitors: DataFrame, k: int, dim: int, tmp: Scratch) -> DataFrame:
    """(rid, nid, cos): in each bucket the k best of members(rid, raw, bucket) for visitors(rid, raw, least, bucket)."""
    rows = members.withColumn("least", F.lit(None).cast("double")).unionByName(visitors)
    is_member = F.col("least").isNull()
    # buckets over the limits are met block by block; hot ones among them, fewer than HOT_PARTS, are told to every task
    sizes = rows.groupBy("bucket").agg(F.count_if(is_member).alias("nm"), F.count_if(~is_member).alias("nq")).where((F.col("nm") > MEMBERS) | (F.col("nq") > VISITORS))
    big, crowded = tmp.save(sizes.select("bucket", F.ceil(F.col("nm") / MEMBERS).cast("int").alias("mb"), F.ceil(F.col("nq") / VISITORS).cast("int").alias("qb"), (F.col("nm") + F.col("nq")).alias("n")), "big"), []
    if not big.isEmpty():
        total = rows.count()
        crowded = [r.bucket for r in big.where(F.col("n") * HOT_PARTS > total).orderBy(F.desc("n")).limit(HOT_PARTS).select("bucket").collect()]
    cut = lookup_join(rows, big.drop("n"), "bucket", crowded, "left").withColumns({"mb": F.greatest(F.coalesce("mb", F.lit(1)), F.lit(1)), "qb": F.greatest(F.coalesce("qb", F.lit(1)), F.lit(1))})
    mine = F.pmod(F.xxhash64("rid"), F.when(is_member, F.col("mb")).otherwise(F.col("qb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(is_member, F.col("qb")).otherwise(F.col("mb")) - 1))
    cut = cut.select("rid", "raw", "least", "bucket", mine.alias("mine"), other.alias("other"))
    cell = F.xxhash64("bucket", F.when(is_member, F.col("mine")).otherwise(F.col("other")), F.when(is_member, F.col("other")).otherwise(F.col("mine")))
    cells = cut.select("rid", "raw", "least", cell.alias("cell")).repartition("cell").sortWithinPartitions("cell")
    return cells.mapInPandas(_rerank(dim, k), "rid long, nid long, cos double")


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """Unordered pairs (id_a < id_b) of which one is among the nearest of the other."""
    return near.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbour_pairs(nearest_vectors(usable_vectors(spark.read.parquet(f"{root}/unit_vectors.parquet"), 64)))
