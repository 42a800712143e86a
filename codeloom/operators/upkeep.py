"""Incremental update, audits, rules and budgets.

Null keys match nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changed_files(stored: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """(path, status), within further keys, from (path, source_hash) on both sides: new, changed, removed or same; a missing stored hash counts as changed."""
    j = stored.select(*keys, "path", F.col("source_hash").alias("old"), F.lit(True).alias("had")).join(current.select(*keys, "path", F.col("source_hash").alias("now"), F.lit(True).alias("has")), [*keys, "path"], "full")
    status = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "removed").when(F.col("old") == F.col("now"), "same").otherwise("changed")
    return j.select(*keys, "path", status.alias("status"))


def update_rows(stored: DataFrame, fresh: DataFrame, files: DataFrame, file_col: str = "file", keys: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows with those of changed, removed and new files replaced by the fresh ones: one anti-join and one semi-join by file."""
    touched = files.where("status <> 'same'").select(*keys, F.col("path").alias(file_col))
    return stored.join(touched, [*keys, file_col], "left_anti").unionByName(fresh.join(touched, [*keys, file_col], "left_semi"))


def overlapping_functions(functions: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """(*keys, fn_id, file) of functions whose span holds a changed line of lines(*keys, file, line); an interval join within each file."""
    l = lines.select(*[F.col(k).alias("_" + k) for k in (*keys, "file")], F.col("line").alias("_line"))
    on = F.col("line_start") <= F.col("_line")
    for k in (*keys, "file"):
        on = on & (F.col(k) == F.col("_" + k))
    return functions.join(l, on & (F.col("_line") <= F.col("line_end")), "left_semi").select(*keys, "fn_id", "file")


def audit_units(units: DataFrame, files: DataFrame, most: int = 30, keys: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, reason), per keys of files, of units that changed files(path) touch: by source file, else by a path standing in their text; at most `most`, function units first."""
    paths = files.select(*keys, "path").distinct()
    by_file = units.select("id", "kind", F.explode("source_files").alias("path")).join(paths, "path").select(*keys, "id", "kind", F.lit("file").alias("reason")).distinct()
    words = units.select("id", "kind", F.explode(F.array_distinct(F.regexp_extract_all("description", F.lit(r"([\w-]+(?:/[\w.-]+)+)"), F.lit(1)))).alias("w"))
    short = paths.select(*keys, F.expr("substring(path, instr(path, '/') + 1)").alias("w"))
    by_text = words.join(short, "w").select(*keys, "id", "kind", F.lit("text").alias("reason")).distinct()
    both = by_file.unionByName(by_text.join(by_file.select(*keys, "id"), [*keys, "id"], "left_anti")).select(*keys, "id", "kind", "reason")
    order = [F.when(F.col("kind") == "function_unit", 0).otherwise(1), F.when(F.col("reason") == "file", 0).otherwise(1), F.col("id")]
    if not keys:
        return both.orderBy(*order).limit(most)
    return both.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= most).drop("n")


def popular_files(imports: DataFrame, least: int = 3) -> DataFrame:
    """Files that `least` or more others import."""
    return imports.groupBy(F.col("target_file").alias("path")).agg(F.count_distinct("source_file").alias("importers")).where(F.col("importers") >= least)


def redone_tasks(sessions: DataFrame, scored: DataFrame | None = None, limit: float = 0.4) -> DataFrame:
    """(session_id, redo_of): sessions with the task of an earlier session; redo_of is the last one before.

    With scored(session_id, score) only where that one scored under the limit. One window over
    the task, no self-join of all sessions with one task.
    """
    w = W.partitionBy("task_hash").orderBy("started_at", "session_id")
    out = sessions.where("task_hash is not null").select("session_id", F.lag("session_id").over(w).alias("redo_of")).where("redo_of is not null")
    if scored is None:
        return out
    return out.join(scored.where(F.col("score") < limit).select(F.col("session_id").alias("redo_of")), "redo_of", "left_semi").select("session_id", "redo_of")


def one_per_category(rules: DataFrame) -> DataFrame:
    """(category, id, summary): the last manual rule of each category, else its first; summary is the first sentence."""
    manual = F.col("source") == "manual"
    w = W.partitionBy("category").orderBy(F.when(manual, 0).otherwise(1), F.when(manual, F.negative("id")).otherwise(F.col("id")))
    first = F.rtrim(F.regexp_replace(F.split_part("content", F.lit(". "), F.lit(1)), r"\.+$", ""))
    return rules.withColumn("n", F.row_number().over(w)).where("n = 1").select("category", "id", first.alias("summary"))


def open_insights(insights: DataFrame) -> DataFrame:
    """Unfixed insights, high priority first, then by occurrences."""
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).when(F.col("priority") == "low", 2).otherwise(3)
    return insights.where("status = 'open'").orderBy(order, F.desc("occurrences"), "description")


def greedy_budget(sections: Column, budget: int) -> Column:
    """Names of array<struct<name,tokens>> sections taken in order while they fit; one that doesn't fit is skipped and later ones are still tried."""
    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, s: Column) -> Column:
        fits = acc["used"] + s["tokens"] <= budget
        return F.struct(F.when(fits, F.concat(acc["names"], F.array(s["name"]))).otherwise(acc["names"]).alias("names"), F.when(fits, acc["used"] + s["tokens"]).otherwise(acc["used"]).alias("used"))

    return F.aggregate(sections, start, step)["names"]
