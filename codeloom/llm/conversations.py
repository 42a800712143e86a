"""Rebuilding conversations from message rows.

Method: the reply graph of a session is sorted topologically by Kahn's algorithm with the
time as tie-breaker; nodes left over reveal cycles; then roles, their alternation and
completeness are checked. Beside this order (pos) every message has its place in time
(time_pos), and those that the clock puts before the message they answer are marked.
Sessions too large for one task get the same orders from pointer doubling and a range sort.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.keys import blank_to_null, plain_session, utc_millis
from codeloom.runtime import Scratch

#: Rows of a session that one task may hold; larger sessions are sorted by the whole cluster.
SESSION_ROWS = 100_000
#: Stands for "before all times": a row without time and parent comes first.
FIRST = -(1 << 62)


def _spoken(message) -> bool:
    content = message.get("content") if isinstance(message, dict) else None
    if isinstance(content, str):
        return bool(content.strip())
    if isinstance(content, list):
        return any(isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"].strip() for b in content)
    return False


def _read_messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Validity, role and spokenness of each message text."""
    for batch in batches:
        ok, spoken = [], []
        for kind, text in zip(batch["kind"], batch["message"]):
            if kind not in ("user", "assistant"):
                ok.append(True)
                spoken.append(False)
                continue
            try:
                message = json.loads(text)
            except (TypeError, ValueError, RecursionError):
                ok.append(False)
                spoken.append(False)
                continue
            role = message.get("role") if isinstance(message, dict) else None
            role = role.strip().lower() if isinstance(role, str) else ""
            ok.append(role in ("", kind))
            spoken.append(_spoken(message))
        batch = batch.drop(columns=["message"])
        yield batch.assign(ok=ok, spoken=spoken)


def message_rows(transcript: DataFrame) -> DataFrame:
    """(session_id, uuid, parent, kind, t, ok, spoken), one row per uuid of a session.

    Of resent rows the one received last holds. Rows without session are left out; rows
    without uuid each stand for themselves. t is in microseconds UTC, null where the time is
    missing or can't be read. ok is false for a user or assistant row whose message isn't
    valid JSON (null and empty aren't) or whose role contradicts the row's type.
    """
    rows = transcript.select(
        plain_session(F.col("session_id")).alias("session_id"), blank_to_null(F.col("uuid")).alias("uuid"), blank_to_null(F.col("parent_uuid")).alias("parent"),
        F.lower(F.trim("entry_type")).alias("kind"), F.unix_micros(utc_millis(F.col("ts"))).alias("t"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("got"), "message",
    ).where("session_id is not null")
    read = rows.mapInPandas(_read_messages, "session_id string, uuid string, parent string, kind string, t double, got double, ok boolean, spoken boolean")
    read = read.withColumn("t", F.col("t").cast("long"))
    named = read.where("uuid is not null").groupBy("session_id", "uuid").agg(F.max(F.struct("got", "t", "parent", "kind", "ok", "spoken")).alias("m"))
    named = named.select("session_id", "uuid", "m.parent", "m.kind", "m.t", "m.ok", "m.spoken")
    return named.unionByName(read.where("uuid is null").drop("got"))


def kahn_order(uuids: list, parents: list, times: list) -> tuple[list[int], list[int], list[bool], bool, bool]:
    """(topological order, order of time, breaks, orphaned, cyclic) of one session's rows.

    A row without time has its parent's. Kahn's algorithm takes, of the rows whose parent is
    out, the one with the least time (never less than its parent's); among equal ones a reply
    follows its parent (depth), then the uuid decides. The order of time has the same ties.
    breaks tells per row whether the order of time puts it before its parent; orphaned: a
    parent names no row; cyclic: rows were left over, which the first order lacks.
    """
    at = {u: i for i, u in enumerate(uuids) if u is not None}
    n = len(uuids)
    children: list[list[int]] = [[] for _ in range(n)]
    up = [-1] * n
    orphaned = False
    for i, p in enumerate(parents):
        if p is None:
            continue
        j = at.get(p)
        if j is None:
            orphaned = True
        else:
            children[j].append(i)
            up[i] = j
    names = [u or "" for u in uuids]
    eff = [FIRST if t is None else t for t in times]
    late = list(eff)  # not before any row it answers
    depth, level = [0] * n, [0] * n
    heap = [(late[i], 0, names[i], i) for i in range(n) if up[i] < 0]
    heapq.heapify(heap)
    order = []
    while heap:
        i = heapq.heappop(heap)[3]
        order.append(i)
        for c in children[i]:
            if times[c] is None:
                eff[c] = eff[i]
            depth[c] = depth[i] + 1 if eff[c] == eff[i] else 0
            late[c] = max(eff[c], late[i])
            level[c] = level[i] + 1 if late[c] == late[i] else 0
            heapq.heappush(heap, (late[c], level[c], names[c], c))
    by_time = sorted(range(n), key=lambda i: (eff[i], depth[i], names[i]))
    place = [0] * n
    for k, i in enumerate(by_time):
        place[i] = k
    return order, by_time, [j >= 0 and place[i] < place[j] for i, j in enumerate(up)], orphaned, len(order) < n


SCHEMA = "session_id string, pos int, time_pos int, uuid string, speaker string, breaks_reply_order boolean, alternates boolean"
_COLS = [c.split()[0] for c in SCHEMA.split(", ")]


def _session(name: str, uuids: list, parents: list, times: list, kinds: list, spoken: list) -> list[tuple]:
    """Rows of SCHEMA of one session whose messages are all valid; none if it is dropped."""
    if not any(spoken):
        return []
    order, by_time, breaks, orphaned, cyclic = kahn_order(uuids, parents, times)
    if orphaned or cyclic:
        return []
    said = [i for i in by_time if spoken[i]]
    if kinds[said[0]] != "user" or kinds[said[-1]] != "assistant":
        return []
    place = {i: k for k, i in enumerate(said)}
    said = [i for i in order if spoken[i]]
    turns = all(kinds[a] != kinds[b] for a, b in zip(said, said[1:]))
    return [(name, k, place[i], uuids[i], kinds[i], breaks[i], turns) for k, i in enumerate(said)]


def _rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The conversations of rows sorted by session; a session that a batch cuts off waits for the next."""

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["session_id"].to_numpy(dtype=object)
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        uuids, parents, kinds = ([x if isinstance(x, str) else None for x in rows[c].tolist()] for c in ("uuid", "parent", "kind"))
        times = [None if x != x or x is None else int(x) for x in rows["t"].tolist()]
        ok, spoken = rows["ok"].tolist(), rows["spoken"].tolist()
        out: list[tuple] = []
        for a, b in zip(edges, edges[1:]):
            if all(ok[a:b]):
                out += _session(ids[a], uuids[a:b], parents[a:b], times[a:b], kinds[a:b], spoken[a:b])
        return pd.DataFrame(out, columns=_COLS, dtype=object)

    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        ids = rows["session_id"].to_numpy(dtype=object)
        last = len(ids) - int(np.argmax(ids[::-1] != ids[-1])) if (ids != ids[-1]).any() else 0
        rest = rows.iloc[last:]
        if last:
            yield finish(rows.iloc[:last])
    if rest is not None:
        yield finish(rest)


def _placed(said: DataFrame, tmp: Scratch, order: list[str], name: str) -> DataFrame:
    """(key, name) of the rows of said(session_id, key, ...): places from 0 within their session, by a range sort over the whole cluster."""
    rows = said.repartitionByRange("session_id", *order).sortWithinPartitions("session_id", *order)
    rows = tmp.save(rows.select("session_id", "key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "sorted")
    sizes = rows.groupBy("session_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("from"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("session_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row of sizes stands for a partition's share of a session: at most partitions plus large sessions, so bounded
    placed = rows.join(F.broadcast(sizes.select("session_id", "part", "from", before.alias("before"))), ["session_id", "part"])
    return placed.select("key", (F.col("before") + F.col("seq") - F.col("from")).cast("int").alias(name))


def _rebuild_large(rows: DataFrame, longest: int, tmp: Scratch) -> DataFrame:
    """The same for sessions of any size up to `longest` rows: chains of replies are shortened by pointer doubling."""
    rows = tmp.save(rows.withColumn("key", F.xxhash64("session_id", F.coalesce("uuid", F.uuid()))), "large")
    named = rows.where("uuid is not null")
    parents = named.select("session_id", F.col("uuid").alias("parent"), F.col("key").alias("up"))
    linked = tmp.save(rows.join(parents, ["session_id", "parent"], "left"), "linked")
    orphaned = linked.where("parent is not null and up is null").select("session_id").distinct()

    def double(state: DataFrame, merge) -> DataFrame:
        """Follow `up` to its end; no chain is longer than a session, so rows that still have an `up` behind the last round lie on a cycle."""
        for _ in range(math.ceil(math.log2(max(longest, 2))) + 1):
            if state.where("up is not null").isEmpty():
                break
            far = state.select(F.col("key").alias("up"), F.col("up").alias("up2"), *[F.col(c).alias(c + "2") for c in state.columns if c not in ("key", "up")])
            state = tmp.save(merge(state.where("up is not null").join(far, "up")).unionByName(state.where("up is null")), "jump")
        return state

    roots = double(linked.select("key", "up"), lambda j: j.select("key", F.col("up2").alias("up")))
    cyclic = roots.where("up is not null").select("key").join(rows.select("key", "session_id"), "key").select("session_id").distinct()
    bad = tmp.save(rows.where("not ok").select("session_id").unionByName(orphaned).unionByName(cyclic).distinct(), "bad")
    linked = tmp.save(linked.join(bad, "session_id", "left_anti"), "sound")

    def level(by: DataFrame) -> DataFrame:
        """(key, n): rows above with the same value x of by(key, x), counted along the chain."""
        pairs = linked.select("key", "up").join(by, "key").join(by.select(F.col("key").alias("up"), F.col("x").alias("x_up")), "up", "left")
        same = F.coalesce(F.col("x") == F.col("x_up"), F.lit(False))
        run = tmp.save(pairs.select("key", F.when(same, F.col("up")).alias("up"), same.cast("long").alias("n")), "run")
        return double(run, lambda j: j.select("key", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"))).select("key", "n")

    timed = linked.select("key", F.when(F.col("t").isNull(), F.col("up")).alias("up"), "t")
    timed = double(timed, lambda j: j.select("key", F.when(F.col("t2").isNull(), F.col("up2")).alias("up"), F.col("t2").alias("t")))
    eff = tmp.save(timed.select("key", F.coalesce("t", F.lit(FIRST)).alias("x")), "eff")
    late = double(linked.select("key", "up").join(eff, "key").select("key", "up", "x"), lambda j: j.select("key", F.col("up2").alias("up"), F.greatest("x", "x2").alias("x"))).select("key", "x")
    full = rows.join(eff.withColumnRenamed("x", "eff"), "key").join(level(eff).withColumnRenamed("n", "depth"), "key").join(late.withColumnRenamed("x", "late"), "key").join(level(late).withColumnRenamed("n", "level"), "key")
    full = tmp.save(full, "full")
    said = full.where("spoken")
    first_order, time_order = ["late", "level", "uuid"], ["eff", "depth", "uuid"]
    above = full.select(F.col("key").alias("up"), F.struct(*time_order).alias("above"))
    breaks = linked.select("key", "up").join(above, "up").join(full.select("key", F.struct(*time_order).alias("own")), "key").select("key", (F.col("own") < F.col("above")).alias("breaks_reply_order"))
    out = said.select("session_id", "key", "uuid", F.col("kind").alias("speaker")).join(_placed(said, tmp, first_order, "pos"), "key").join(_placed(said, tmp, time_order, "time_pos"), "key").join(breaks, "key", "left").fillna(False, ["breaks_reply_order"])
    out = tmp.save(out, "placed")
    pair = out.select("session_id", "speaker", F.explode(F.array(F.col("pos"), F.col("pos") + 1)).alias("gap"), "pos")
    repeats = pair.groupBy("session_id", "gap").agg(F.count(F.lit(1)).alias("k"), F.min("speaker").alias("a"), F.max("speaker").alias("b")).where("k = 2 and a = b").select("session_id", F.lit(False).alias("alternates")).distinct()
    ends = out.groupBy("session_id").agg(F.min_by("speaker", "time_pos").alias("opens"), F.max_by("speaker", "time_pos").alias("closes")).where("opens = 'user' and closes = 'assistant'").select("session_id")
    kept = ends.join(repeats, "session_id", "left").fillna(True, ["alternates"])
    return out.join(F.broadcast(kept), "session_id").select(*_COLS)  # large sessions only: fewer than rows / session_rows


def conversations(rows: DataFrame, session_rows: int = SESSION_ROWS) -> DataFrame:
    """(session_id, pos, time_pos, uuid, speaker, breaks_reply_order, alternates): the spoken messages of every conversation kept.

    pos counts in topological order, time_pos in order of time; alternates tells whether the
    speakers of the conversation take turns. Dropped is a session with no spoken message, one
    not opened by the user or not closed by the assistant, with a parent that names no row of
    it, with a cycle of replies, or with a message that isn't valid JSON or contradicts its
    row's type.
    """
    tmp = Scratch(rows.sparkSession, "conversations")
    rows = tmp.save(rows, "rows")
    sizes = rows.groupBy("session_id").count().where(F.col("count") > session_rows)
    large = tmp.save(sizes.select("session_id", "count"), "large_ids")
    longest = large.agg(F.max("count").alias("n")).first().n
    few = rows if longest is None else rows.join(F.broadcast(large), "session_id", "left_anti")  # there are fewer large sessions than rows / session_rows
    out = few.repartition("session_id").sortWithinPartitions("session_id").mapInPandas(_rebuild, SCHEMA)
    if longest is None:
        return out
    return out.unionByName(_rebuild_large(rows.join(F.broadcast(large), "session_id", "left_semi"), longest, tmp))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The messages of the kept conversations by their place in time."""
    got = conversations(message_rows(spark.read.parquet(f"{root}/transcript.parquet")))
    return got.select("session_id", F.col("time_pos").alias("pos"), "uuid")


def p3_conversations(spark: SparkSession, root: str) -> DataFrame:
    """The kept conversations in topological order, with speakers, alternation and the messages whose time contradicts it."""
    return conversations(message_rows(spark.read.parquet(f"{root}/transcript.parquet")))
