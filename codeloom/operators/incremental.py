"""Differences and incremental maintenance: signatures, values, upserts, embeddings, history.

Keys must be given; a null key matches nothing. Empty sides are allowed: everything is then
added or removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import text as T


def signature_diff(before: DataFrame, after: DataFrame, callers: DataFrame, *keys: str) -> DataFrame:
    """(fn_id, change, note, callers), within further keys: functions added, removed or with another signature; a signature that only grows is additive."""
    old = before.select(*keys, "fn_id", T.signature(F.col("params"), F.col("return_type")).alias("old"))
    new = after.select(*keys, "fn_id", T.signature(F.col("params"), F.col("return_type")).alias("new"))
    j = old.join(new, [*keys, "fn_id"], "full").where(F.col("old").isNull() | F.col("new").isNull() | (F.col("old") != F.col("new")))
    head = F.split_part("old", F.lit(")"), F.lit(1))
    note = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.when(F.col("new").startswith(head), "additive").otherwise("breaking"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return j.join(callers, [*keys, "fn_id"], "left").select(*keys, "fn_id", change.alias("change"), note.alias("note"), F.coalesce("callers", F.lit(0)).alias("callers"))


def value_diff(before: DataFrame, after: DataFrame, key: str, values: str, *keys: str) -> DataFrame:
    """(key, added, removed), within further keys: array values gained and lost by the keys of both sides, as sorted text."""
    clean = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    j = before.select(*keys, key, clean(F.col(values)).alias("b")).join(after.select(*keys, key, clean(F.col(values)).alias("a")), [*keys, key])
    text = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), "|")
    return j.select(*keys, key, text("a", "b").alias("added"), text("b", "a").alias("removed")).where("added <> '' or removed <> ''")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes in place of those with the same key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def prune(rows: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still alive."""
    return rows.join(live.select(key), key, "left_semi")


def refresh_plan(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(status, n) of an index over (id, hash): reuse equal hashes, encode new or changed ids, remove the rest."""
    j = stored.select("id", F.col("hash").alias("old")).join(current.select("id", F.col("hash").alias("new"), F.lit(True).alias("live")), "id", "full")
    status = F.when(F.col("live").isNull(), "remove").when(F.col("old").eqNullSafe(F.col("new")) & F.col("old").isNotNull(), "reuse").otherwise("encode")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def debt_score(functions: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """(*keys, debt_score, debt_density) of complex and long functions and large files, as debt_summary weighs them; import cycles are left out."""
    c, n, k = F.col("complexity"), F.col("line_count"), F.size(F.coalesce("function_ids", F.array().cast("array<string>")))
    f = functions.groupBy(*keys).agg((F.count_if((c >= 15)) + F.count_if(n >= 100)).alias("high"), (F.count_if((c >= 10) & (c < 15)) + F.count_if((n >= 50) & (n < 100))).alias("medium"), F.count(F.lit(1)).alias("n"))
    p = files.groupBy(*keys).agg(F.count_if(k >= 30).alias("h2"), F.count_if((k >= 15) & (k < 30)).alias("m2"))
    j = f.join(p, list(keys), "full").fillna(0, ["high", "medium", "n", "h2", "m2"])
    score = 3 * (F.col("high") + F.col("h2")) + F.col("medium") + F.col("m2")
    return j.select(*keys, score.alias("debt_score"), T.round_half_up(score * 100.0 / F.greatest("n", F.lit(1)), 1).alias("debt_density"))


def snapshot_history(functions: DataFrame, edges: DataFrame, files: DataFrame, calendar: DataFrame, keep: int = 20) -> DataFrame:
    """Per snapshot (of the newest `keep`): projects delivered, their functions, edges, files, complexity and debt, and the change of each since the project's previous delivered snapshot.

    The tables hold one row per key, project and delivered snapshot (functions complexity and
    line_count, files function_ids as well). A project's first snapshot changes nothing, and
    one that isn't delivered is neither counted nor taken as lost.
    """
    keys = ["project", "snapshot_id"]
    f = functions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_functions"), F.coalesce(F.sum("complexity"), F.lit(0)).alias("complexity"))
    e = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    p = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"))
    names = ["n_functions", "complexity", "n_edges", "n_files", "debt_score"]
    rows = calendar.select(*keys, "prev_id").join(f, keys, "left").join(e, keys, "left").join(p, keys, "left").join(debt_score(functions, files, *keys).drop("debt_density"), keys, "left").fillna(0, names)
    w = W.partitionBy("project").orderBy("snapshot_id")  # one row per snapshot of the project
    rows = rows.select("snapshot_id", *names, *[F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)).alias("d_" + c) for c in names])
    total = rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_projects"), *[F.sum(c).alias(c) for c in names], *[F.sum("d_" + c).alias("d_" + c) for c in names])
    return total.orderBy(F.desc("snapshot_id")).limit(keep)


def changed_keys(changes: DataFrame, most: int = 10) -> DataFrame:
    """(entity, snapshot_id, change_kind, n, first_keys): of the changes of snapshots (entity, snapshot_id, key_a, key_b, change_kind), their number and the first `most` keys in order."""
    keys = ["entity", "snapshot_id", "change_kind"]
    name = F.when(F.col("key_b") != "", F.concat_ws(" -> ", "key_a", "key_b")).otherwise(F.col("key_a"))
    n = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = changes.select(*keys, name.alias("key")).withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("key"))).where(F.col("r") <= most)
    return n.join(top.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("key")), "|").alias("first_keys")), keys)


def debt_delta(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """One row (per keys): change of summed complexity, longest function after, functions gained."""
    b = before.groupBy(*keys).agg(F.coalesce(F.sum("complexity"), F.lit(0)).alias("c0"), F.count(F.lit(1)).alias("n0"))
    a = after.groupBy(*keys).agg(F.coalesce(F.sum("complexity"), F.lit(0)).alias("c1"), F.max("line_count").alias("max_function_lines"), F.count(F.lit(1)).alias("n1"))
    j = a.join(b, list(keys), "full").fillna(0, ["c0", "c1", "n0", "n1"]) if keys else a.crossJoin(b)
    return j.select(*keys, (F.col("c1") - F.col("c0")).alias("complexity_delta"), "max_function_lines", (F.col("n1") - F.col("n0")).alias("functions_delta"))


def file_growth(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """One row (per keys) of files(path, lines_of_code, imports) before and after: largest growth of a file in lines (0 at least), change of the number of import statements, files created."""
    size = lambda d, x: d.select(*keys, "path", F.coalesce("lines_of_code", F.lit(0)).alias("l" + x), F.size(F.array_distinct(F.coalesce("imports", F.array().cast(d.schema["imports"].dataType)))).alias("i" + x), F.lit(1).alias("k" + x))
    j = size(after, "1").join(size(before, "0"), [*keys, "path"], "full").fillna(0, ["l0", "l1", "i0", "i1", "k0", "k1"])
    grown = F.when((F.col("k1") == 1), F.greatest(F.col("l1") - F.col("l0"), F.lit(0))).otherwise(0)
    return j.groupBy(*keys).agg(F.max(grown).alias("biggest_file_growth"), F.sum(F.col("i1") - F.col("i0")).alias("import_edges_delta"), F.count_if((F.col("k1") == 1) & (F.col("k0") == 0)).alias("files_created"))
