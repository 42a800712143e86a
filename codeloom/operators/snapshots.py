"""What changed between full snapshots.

Method: EXCEPT ALL both ways removes the rows that two consecutive snapshots share; what is
left of either side meets in a full join by key, which tells additions, removals and changes
apart. Both EXCEPT ALLs are taken in one aggregate of signed counts (the form into which
Spark itself rewrites a single EXCEPT ALL), so the rows are shuffled once instead of four
times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.keys import plain_key
from codeloom.operators.skew import hot_keys, lookup_join
from codeloom.runtime import Scratch, table

#: Rows of the delivery calendar that may be broadcast: about 40 bytes each, so 16 MB at most (a few times that as objects); more are joined by shuffle.
BROADCAST_ROWS = 400_000


def _text(c: Column) -> Column:
    """Null, empty and blank count as one; surrounding blanks don't matter."""
    return F.coalesce(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def _texts(name: str, *fields: str) -> Column:
    """Array of structs with cleaned text fields; null counts as empty."""
    empty = F.coalesce(F.col(name), F.array().cast("array<struct<%s>>" % ",".join(f"{f}:string" for f in fields)))
    return F.transform(empty, lambda x: F.struct(*[_text(x[f]).alias(f) for f in fields]))


def _strings(name: str, clean=_text) -> Column:
    empty = F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.sort_array(F.transform(empty, lambda x: F.coalesce(clean(x), F.lit(""))))


def _hash(content: list[tuple[Column, bool]]) -> Column:
    """64-bit hash of cleaned columns; only rows of one key are ever compared by it."""
    parts: list[Column] = []
    for c, array in content:
        parts += [F.size(c), c] if array else [_text(c.cast("string"))]
    return F.xxhash64(*parts)


def latest_states(rows: DataFrame, key_a: Column, key_b: Column, content: list[tuple[Column, bool]], entity: str) -> DataFrame:
    """(entity, project, snapshot_id, key_a, key_b, loaded_at, content) before de-duplication; rows without key or snapshot are left out."""
    out = rows.select(
        F.lit(entity).alias("entity"), F.trim("project").alias("project"), F.col("snapshot_id").cast("int").alias("snapshot_id"),
        key_a.alias("key_a"), key_b.alias("key_b"), F.col("loaded_at"), _hash(content).alias("content"),
    )
    return out.where("key_a is not null and key_b is not null and snapshot_id is not null and project is not null")


def graph_states(spark: SparkSession, root: str) -> DataFrame:
    """The comparable content of the three graph tables."""
    f = table(spark, root, "graph_functions")
    functions = latest_states(
        f, plain_key(F.col("id")), F.lit(""),
        [(F.col(c), False) for c in ("fn_name", "kind", "prog_lang", "return_type", "docstring", "route", "http_method", "template", "ast_hash", "intent", "text_lang", "class_name", "is_async", "complexity", "line_count")]
        + [(_texts("params", "name", "type_hint", "default_value"), True), (_strings("secondary_intents"), True)],
        "functions",
    )
    e = table(spark, root, "graph_call_edges")
    edges = latest_states(
        e, plain_key(F.col("source_fn")), plain_key(F.col("target_fn")),
        [(plain_key(F.col("site_file")), False), (F.col("expression"), False), (F.round("confidence", 2), False)], "call_edges",
    )
    p = table(spark, root, "graph_files")
    files = latest_states(
        p, plain_key(F.col("path")), F.lit(""),
        [(F.col(c), False) for c in ("prog_lang", "zone_name", "source_hash", "lines_of_code")]
        + [(F.sort_array(_texts("imports", "capture", "text")), True), (_strings("function_ids", plain_key), True)],
        "files",
    )
    return functions.unionByName(edges).unionByName(files)


def delivery_calendar(files: DataFrame) -> DataFrame:
    """(project, snapshot_id, prev_id, next_id) of the snapshots in which a project has rows."""
    from pyspark.sql import Window as W

    w = W.partitionBy("project").orderBy("snapshot_id")
    seen = files.select(F.trim("project").alias("project"), F.col("snapshot_id").cast("int").alias("snapshot_id")).where("project is not null and snapshot_id is not null").distinct()
    return seen.select("project", "snapshot_id", F.lag("snapshot_id").over(w).alias("prev_id"), F.lead("snapshot_id").over(w).alias("next_id"))


def transitions(states: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """states(project, snapshot_id, ...) before and after each transition between a project's delivered snapshots; snapshot_id is the later one of both sides."""
    dated = states.withColumn("project", F.trim("project")).withColumn("snapshot_id", F.col("snapshot_id").cast("int")).join(calendar, ["project", "snapshot_id"])
    before = dated.where("next_id is not null").withColumn("snapshot_id", F.col("next_id"))
    return before.drop("prev_id", "next_id"), dated.where("prev_id is not null").drop("prev_id", "next_id")


def snapshot_changes(states: DataFrame, calendar: DataFrame) -> DataFrame:
    """(entity, snapshot_id, key_a, key_b, change_kind) between consecutive delivered snapshots.

    Of several rows of one key in one snapshot the one loaded last counts, however late (at
    equal times the larger content hash, so that the result doesn't depend on row order). A
    project's first delivered snapshot is compared with none and gives no rows; rows of a
    project in a snapshot that doesn't deliver it are ignored. Empty tables give no rows.
    """
    tmp = Scratch(states.sparkSession, "snapshots")
    keys = ["entity", "project", "snapshot_id", "key_a", "key_b"]
    last = states.groupBy(*keys).agg(F.max(F.struct("loaded_at", "content")).alias("m")).select(*keys, F.col("m.content").alias("content"))
    dates = tmp.save(calendar.select(F.struct("project", "snapshot_id").alias("at"), "prev_id", "next_id"), "calendar")
    last = last.withColumn("at", F.struct("project", "snapshot_id"))
    if dates.count() <= BROADCAST_ROWS:
        dated = last.join(F.broadcast(dates), "at")
    else:
        busy = [tuple(x) for x in hot_keys(states.select(F.struct("project", "snapshot_id").alias("at")), "at")]
        flat = last.drop("at").withColumn("at", F.concat_ws("\u0001", "project", "snapshot_id"))
        dated = lookup_join(flat, dates.withColumn("at", F.concat_ws("\u0001", "at.project", "at.snapshot_id")), "at", [f"{p}\u0001{s}" for p, s in busy])
    # one row per side: +1 as a row of its own snapshot, -1 as a row of the project's next one
    sides = F.filter(
        F.array(F.struct(F.col("snapshot_id").alias("s"), F.lit(1).alias("n"), F.col("prev_id").isNotNull().alias("ok")), F.struct(F.col("next_id").alias("s"), F.lit(-1).alias("n"), F.col("next_id").isNotNull().alias("ok"))),
        lambda x: x["ok"],
    )
    signed = dated.select("entity", "project", "key_a", "key_b", "content", F.explode(sides).alias("x")).select("entity", "project", F.col("x.s").alias("snapshot_id"), "key_a", "key_b", "content", F.col("x.n").alias("n"))
    at = ["entity", "project", "snapshot_id", "key_a", "key_b"]
    rest = signed.groupBy(*at, "content").agg(F.sum("n").alias("n")).where("n <> 0")
    rest = tmp.save(rest, "residue")
    tmp.keep_only("residue")
    new = rest.where("n > 0").select(*at, F.lit(1).alias("now"))
    old = rest.where("n < 0").select(*at, F.lit(1).alias("before"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return new.join(old, at, "full").select("entity", "snapshot_id", "key_a", "key_b", kind.alias("change_kind"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(graph_states(spark, root), delivery_calendar(table(spark, root, "graph_files")))
