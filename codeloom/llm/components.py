"""Consolidating pairwise matches into groups (connected components).

Method: the giant component is peeled off by breadth-first joins from the vertex of highest
degree and anti-joined away; the small components left are labelled by minimum propagation.

Order-preserving numbers replace the ids while the graph is worked on, so the smallest
number of a group is its smallest id by code points.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.keys import plain_key
from codeloom.operators.skew import HOT_PARTS, hot_keys, lookup_join
from codeloom.runtime import Scratch

#: Rows of a looked-up table that may be broadcast (two numbers each; ids up to a few hundred bytes); larger ones are joined by shuffle, their hot keys apart.
BROADCAST_ROWS, BROADCAST_IDS = 400_000, 100_000
#: Breadth-first rounds before what is reached so far is contracted into one vertex instead.
MAX_BFS_ROUNDS = 24


def match_links(matches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Distinct links (a < b) of match rows fn_a, fn_b, kind, similarity.

    A row links if both ends are given (null and blank are not) and differ in plain form, and
    its kind is `exact` in any case with a missing score (null or NaN), or its score, a
    percentage where above 1, reaches the threshold. No rows give no links.
    """
    score = F.when(~F.isnan("similarity"), F.col("similarity"))
    score = F.when(score > 1, score / 100).otherwise(score)
    rows = matches.select(plain_key(F.col("fn_a")).alias("x"), plain_key(F.col("fn_b")).alias("y"), F.lower(F.trim("kind")).alias("kind"), score.alias("score"))
    rows = rows.where((F.col("x") != F.col("y")) & (((F.col("kind") == "exact") & F.col("score").isNull()) | (F.col("score") >= threshold)))
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connected_groups(links: DataFrame, max_bfs_rounds: int = MAX_BFS_ROUNDS) -> DataFrame:
    """(id, group_id) for every id of links(a, b); group_id is the group's smallest id.

    Links may repeat or be turned round; rows with a null end or two equal ends are ignored;
    no links give no rows. Exact at every diameter and group size: breadth-first rounds that
    don't end in time are contracted, not cut off.
    """
    spark: SparkSession = links.sparkSession
    tmp = Scratch(spark, "groups")
    pairs = tmp.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    names = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg")).sort("id")
    nodes, n_nodes = _counted(tmp, names.select("id", F.monotonically_increasing_id().alias("v"), "deg"), "nodes")
    ids_fit = n_nodes <= BROADCAST_IDS
    # the vertices of highest degree, those among them that hold more than 1/200 of the links, and the number of links
    ends = F.broadcast(nodes.agg((F.sum("deg") / 2).alias("m")))
    top = nodes.orderBy(F.desc("deg"), "v").limit(HOT_PARTS).crossJoin(ends).collect()
    if not top:
        return nodes.select("id", F.col("id").alias("group_id"))
    hot = [r.id for r in top if r.deg * HOT_PARTS > r.m]
    hot_v = [r.v for r in top if r.deg * HOT_PARTS > r.m]
    number = nodes.select("id", "v")
    e = _look(pairs, number.withColumnRenamed("id", "a").withColumnRenamed("v", "va"), "a", ids_fit, lambda: hot)
    e = _look(e, number.withColumnRenamed("id", "b").withColumnRenamed("v", "vb"), "b", ids_fit, lambda: hot)
    edges = tmp.save(e.select(F.least("va", "vb").alias("s"), F.greatest("va", "vb").alias("t")), "edges")

    # The component of the busiest vertex, ring by ring. Links that led out of a ring are used
    # up; once they are half of what is read each round, they are left out of it.
    root, rings, ended = top[0].v, [], False
    open_links, n_open, n_used = edges.unionByName(edges.select(F.col("t").alias("s"), F.col("s").alias("t"))), 2 * top[0].m, 0
    ring, n, n_giant = spark.range(1).select(F.lit(root).cast("long").alias("v")), 1, 1
    rings.append(ring)
    for _ in range(max_bfs_rounds):
        used, k = _counted(tmp, _look(open_links, ring.withColumnRenamed("v", "s"), "s", n <= BROADCAST_ROWS, lambda: hot_v).select(F.col("t").alias("v")), "used")
        n_used += k
        seen = rings[-1] if len(rings) == 1 else rings[-1].unionByName(rings[-2])  # a neighbour of ring k lies in ring k-1, k or k+1
        ring, n = _counted(tmp, used.distinct().join(seen, "v", "left_anti"), "ring")
        if not n:
            ended = True
            break
        if 2 * n_used >= n_open:
            mark = _union(rings).select(F.col("v").alias("s"), F.lit(True).alias("out"))
            open_links = tmp.save(_look(open_links, mark, "s", n_giant <= BROADCAST_ROWS, lambda: hot_v, "left").where("out is null").drop("out"), "links")
            n_open, n_used = n_open - n_used, 0
        rings.append(ring)
        n_giant += n
    giant, fits = _union(rings), n_giant <= BROADCAST_ROWS
    least = giant.agg(F.min("v").alias("m")).first().m
    if ended:  # what leads out of the giant leads into it, so the links left lie outside, each in both directions
        mark = giant.select(F.col("v").alias("s"), F.lit(True).alias("out"))
        rest = _look(open_links.where("s < t"), mark, "s", fits, lambda: hot_v, "left").where("out is null").drop("out")
    else:  # a long tail hangs on: what is reached becomes its smallest vertex
        mark = giant.select("v", F.lit(least).alias("g"))
        rest = _look(edges, mark.withColumnRenamed("v", "s").withColumnRenamed("g", "gs"), "s", fits, lambda: hot_v, "left")
        rest = _look(rest, mark.withColumnRenamed("v", "t").withColumnRenamed("g", "gt"), "t", fits, lambda: hot_v, "left")
        rest = rest.select(F.coalesce("gs", "s").alias("x"), F.coalesce("gt", "t").alias("y")).where("x <> y").select(F.least("x", "y").alias("s"), F.greatest("x", "y").alias("t")).distinct()

    small = _propagate(tmp, rest)
    if not ended:  # the giant has one label, which the tail may have lowered
        low = small.where(F.col("v") == least).select("g").first()
        small, least = small.join(giant, "v", "left_anti"), low.g if low else least
    labels = tmp.save(giant.select("v", F.lit(least).cast("long").alias("g")).unionByName(small), "labels")
    tmp.keep_only("nodes", "labels")
    named = _look(labels, number, "v", ids_fit, lambda: []).withColumnRenamed("g", "gv")
    owner = number.withColumnRenamed("v", "gv").withColumnRenamed("id", "group_id")
    return _look(named, owner, "gv", ids_fit, lambda: hot_keys(labels, "g")).select("id", "group_id")


def _look(left: DataFrame, right: DataFrame, key: str, fits: bool, hot, how: str = "inner") -> DataFrame:
    """left join right, which has one row per key: by broadcast if its counted rows fit, else by shuffle with the hot keys that hot() names apart."""
    return left.join(F.broadcast(right), key, how) if fits else lookup_join(left, right, key, hot(), how)


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _counted(tmp: Scratch, df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df written, and its rows counted on the way; only whether the count is zero has to be exact if a task is repeated."""
    seen = Observation()
    out = tmp.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out.select(*df.columns), seen.get["n"]


def _propagate(tmp: Scratch, links: DataFrame) -> DataFrame:
    """(v, g) of the vertices of links(s < t) by minimum propagation.

    Each round every vertex takes the smallest number among itself and its neighbours, the
    chains of these choices are shortened by pointer doubling, and the edges are contracted to
    the vertices they end in. At least half the vertices with edges disappear in a round, so
    the rounds are logarithmic in the number of vertices, whatever the diameter. Vertices that
    many others point to are looked up by broadcast.
    """
    result = None
    edges, left = _counted(tmp, links, "rest")
    while left:
        near = edges.select(F.explode(F.array(F.struct(F.col("s").alias("v"), F.col("s").alias("p")), F.struct(F.col("t").alias("v"), F.col("s").alias("p")))).alias("x")).select("x.*")
        # s < t: the smallest neighbour below t is among its s; a vertex that is only an s keeps itself
        parent, n = _counted(tmp, near.groupBy("v").agg(F.min("p").alias("p")), "parent")
        fits, moved = n <= BROADCAST_ROWS, 1
        while moved:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            nxt = _look(parent, up, "p", fits, lambda: hot_keys(parent, "p")).select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).cast("int").alias("moved"))
            seen = Observation()
            nxt = tmp.save(nxt.observe(seen, F.sum("moved").alias("n")), "jump")
            moved = seen.get["n"]
            parent = nxt.select("v", "p")
        new = _look(edges, parent.select(F.col("v").alias("s"), F.col("p").alias("x")), "s", fits, lambda: hot_keys(edges, "s"))
        new = _look(new, parent.select(F.col("v").alias("t"), F.col("p").alias("y")), "t", fits, lambda: hot_keys(edges, "t"))
        edges, left = _counted(tmp, new.where("x <> y").select(F.least("x", "y").alias("s"), F.greatest("x", "y").alias("t")).distinct(), "contracted")
        if result is None:
            result = parent.select("v", F.col("p").alias("g"))
        else:
            to = parent.select(F.col("v").alias("g"), F.col("p").alias("h"))
            result = tmp.save(_look(result, to, "g", fits, lambda: hot_keys(result, "g"), "left").select("v", F.coalesce("h", "g").alias("g")), "result")
    if result is None:
        return edges.select(F.col("s").alias("v"), F.col("s").alias("g"))
    return result


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    links = match_links(spark.read.parquet(f"{root}/duplicate_matches.parquet"))
    return connected_groups(links).select(F.col("id").alias("fn_id"), "group_id")
