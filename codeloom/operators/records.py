"""Rules, insights, sessions and caches as relations.

rules(id, category, title, content, source, affects), insights(id, target, category,
description, priority, status, occurrences). Null keys match nothing; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rules_of_category(rules: DataFrame, category: str) -> DataFrame:
    """(kind, category, id, title): the rules of a category; where there are none, one row of kind `available` per category there is."""
    hit = rules.where(F.col("category") == category).select(F.lit("rule").alias("kind"), "category", F.col("id").cast("long").alias("id"), "title")
    other = rules.select("category").distinct().select(F.lit("available").alias("kind"), "category", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("title"))
    none = hit.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(True).alias("none"))
    return hit.unionByName(other.crossJoin(F.broadcast(none)).drop("none"))


def rules_by_category(rules: DataFrame) -> DataFrame:
    """(category, n, titles): rules per category, titles in order of id, at most 50."""
    top = rules.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy("id"))).where("r <= 50")
    titles = top.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), "|").alias("titles"))
    return rules.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(titles, "category")


def convention_of(aspects: DataFrame, wanted: DataFrame, zones: DataFrame, monsters: DataFrame) -> DataFrame:
    """(asked, found_as, text): wanted(asked) among aspects(name, text), else zones(name, text), else monster files(name, text), else error."""
    w = wanted.select("asked").distinct()
    parts, left = [], w
    for name, table in (("aspect", aspects), ("zone", zones), ("file", monsters)):
        hit = left.join(table.select(F.col("name").alias("asked"), "text"), "asked").select("asked", F.lit(name).alias("found_as"), "text")
        parts.append(hit)
        left = left.join(hit.select("asked"), "asked", "left_anti")
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.unionByName(left.select("asked", F.lit("error").alias("found_as"), F.lit(None).cast("string").alias("text")))


def coherent_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, id): files(path) and the rules of category `coherence` whose affects name them or end them."""
    from codeloom.operators.rules import coherence

    return coherence(files, rules.where("category = 'coherence'"))


def rule_requests(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """(category, requests, id): how often a category was asked for by calls(name, argument) of a tool whose name ends in rule_read, and the last rule of it."""
    n = calls.where(F.col("name").endswith("rule_read")).groupBy(F.col("argument").alias("category")).agg(F.count(F.lit(1)).alias("requests"))
    return n.join(rules.groupBy("category").agg(F.max("id").alias("id")), "category", "left").select("category", "requests", "id")


def delete_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    return rules.join(gone.select("id"), "id", "left_anti")


def delete_positions(items: Column, positions: list[int]) -> Column:
    """An array without the elements at some positions, counted from 0."""
    return F.transform(F.filter(F.arrays_zip(items.alias("x"), F.sequence(F.lit(0), F.size(items) - 1).alias("i")), lambda z: ~z["i"].isin(positions)), lambda z: z["x"])


def urgent_insights(insights: DataFrame) -> DataFrame:
    """Open insights of high priority, or of medium that occurred at least twice."""
    return insights.where("status = 'open' and (priority = 'high' or (priority = 'medium' and occurrences >= 2))")


def insights_by_target(insights: DataFrame, most: int = 20) -> DataFrame:
    """(target, n, texts): insights per target; the first `most` texts by id."""
    top = insights.withColumn("r", F.row_number().over(W.partitionBy("target").orderBy("id"))).where(F.col("r") <= most)
    texts = top.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "description"))), lambda x: x["description"]), "\n").alias("texts"))
    return insights.groupBy("target").agg(F.count(F.lit(1)).alias("n")).join(texts, "target")


def mark_fixed(insights: DataFrame, fixed: DataFrame) -> DataFrame:
    """insights with the ids of fixed(id) no longer open; by key, not by place in a sorted list."""
    f = fixed.select("id", F.lit(True).alias("_f")).distinct()
    return insights.join(f, "id", "left").withColumn("status", F.when(F.col("_f"), "fixed").otherwise(F.col("status"))).drop("_f").select(*insights.columns)


def debt_insights(insights: DataFrame, scored: DataFrame) -> DataFrame:
    """insights(session_id, category, description, priority) after the rules of a session's score: scored(session_id, score, complexity_delta).

    A session whose complexity grew by over 10 gets an insight on debt if it has none; those on debt of sessions under 0.4 are of high priority.
    """
    missing = scored.where("complexity_delta > 10").join(insights.where("category = 'DEBT'").select("session_id"), "session_id", "left_anti")
    forced = missing.select("session_id", F.lit("DEBT").alias("category"), F.concat(F.lit("Complexity grew by "), F.col("complexity_delta").cast("int"), F.lit(" in this session")).alias("description"), F.lit("high").alias("priority"))
    both = insights.select("session_id", "category", "description", "priority").unionByName(forced)
    low = scored.where("score < 0.4").select("session_id", F.lit(True).alias("low")).distinct()
    return both.join(low, "session_id", "left").withColumn("priority", F.when(F.col("low") & (F.col("category") == "DEBT"), "high").otherwise(F.col("priority"))).drop("low")


def retained_sessions(sessions: DataFrame, most: int = 50, days: int = 7) -> DataFrame:
    """(project, session_id, started_at): sessions(project, session_id, started_at) no older than the project's newest by `days` days, the newest `most`."""
    newest = sessions.groupBy("project").agg(F.max("started_at").alias("newest"))
    live = sessions.join(newest, "project").where(F.col("started_at") > F.col("newest") - F.expr(f"interval {days} days"))
    return live.withColumn("r", F.row_number().over(W.partitionBy("project").orderBy(F.desc("started_at"), "session_id"))).where(F.col("r") <= most).select("project", "session_id", "started_at")


def complex_changes(functions: DataFrame, modified: DataFrame, *keys: str, limit: float = 15.0) -> DataFrame:
    """(*keys, n, average): steps whose modified functions are on average more complex than the limit."""
    rows = functions.join(modified.select(*keys, "fn_id"), [*keys, "fn_id"], "left_semi")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("complexity").alias("average")).where(F.col("average") > limit)


def pending_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.where(~F.coalesce("resolved", F.lit(False)))


def unanalysed(sessions: DataFrame, analysed: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows whose key was not recorded yet."""
    return sessions.join(analysed.select(key), key, "left_anti")


def set_hash(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(*keys, name): a hash of each key's set of values, whatever their order: the sum of the first 48 bits of their SHA-256. Partial sums, so no key's values meet in one task."""
    h = F.conv(F.substring(F.sha2(F.col(value), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.where(F.col(value).isNotNull()).select(*keys, value).distinct().groupBy(*keys).agg(F.sum(h).cast("string").alias(name))


def impact_cache(functions: DataFrame, edges: DataFrame, stored: DataFrame) -> DataFrame:
    """(fn_id, content_hash, state): reuse where stored(fn_id, content_hash) has the hash of a function(fn_id, ast_hash) and its callers, else analyse; functions without hash are skipped."""
    callers = set_hash(edges.select(F.col("target_fn").alias("fn_id"), "source_fn"), ["fn_id"], "source_fn", "callers")
    f = functions.where("ast_hash is not null").join(callers, "fn_id", "left").select("fn_id", F.concat_ws(":", "ast_hash", F.coalesce("callers", F.lit("0"))).alias("content_hash"))
    s = stored.select("fn_id", F.col("content_hash").alias("old"))
    return f.join(s, "fn_id", "left").select("fn_id", "content_hash", F.when(F.col("old") == F.col("content_hash"), "reuse").otherwise("analyse").alias("state"))


def refresh_vectors(stored: DataFrame, current: DataFrame, encoder: Callable, batch: int = 64) -> DataFrame:
    """(id, hash, vec, status): the index after an update. stored(id, hash, vec), current(id, hash, text).

    Rows with an equal hash keep their vector (reuse), others are encoded, ids no longer there are left out.
    """
    from codeloom.operators.rules import encode

    j = current.where("id is not null").join(stored.select("id", F.col("hash").alias("old"), "vec"), "id", "left")
    keep = j.where("old = hash and vec is not null").select("id", "hash", F.col("vec").cast("array<float>").alias("vec"), F.lit("reuse").alias("status"))
    new = j.where("not coalesce(old = hash, false) or vec is null").select("id", "hash", "text")
    made = encode(new, encoder, batch).join(new.select("id", "hash"), "id")
    return keep.unionByName(made.select("id", "hash", "vec", F.lit("encode").alias("status")))


def cached(rows: DataFrame, cache: DataFrame, key: str, value: str, make: Callable[[list[str]], list[str]]) -> DataFrame:
    """rows with `value` from cache(key, value), made by a provider, once per key, where the cache has none."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], value: make(b[key].tolist())})

    made = keys.mapInPandas(run, f"{key} string, {value} string")
    return rows.join(cache.select(key, value).unionByName(made), key, "left")


def apply_impact(functions: DataFrame, results: DataFrame) -> DataFrame:
    """functions(fn_id, intent, secondary_intents, ...) with the intent and tags of results(fn_id, intent, tags) where these give some."""
    r = results.select("fn_id", F.col("intent").alias("_i"), F.col("tags").alias("_t"))
    j = functions.join(r, "fn_id", "left")
    j = j.withColumns({"intent": F.coalesce(F.when(F.trim("_i") != "", F.col("_i")), F.col("intent")), "secondary_intents": F.when(F.size("_t") > 0, F.col("_t")).otherwise(F.col("secondary_intents"))})
    return j.select(*functions.columns)


def take_once(pending: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets to deliver now, taken after that) of pending(id, ...) audits, each delivered once."""
    now = pending.join(taken.select("id"), "id", "left_anti")
    return now, taken.select("id").unionByName(now.select("id")).distinct()


def markdown_audit(rows: DataFrame, most: int = 10) -> DataFrame:
    """(kind, text): per kind of rows(kind, id, reason) a heading and the first `most` entries in order."""
    n = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    top = rows.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy("id", "reason"))).where(F.col("r") <= most)
    lines = top.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("- "), "id", F.lit(" ("), "reason", F.lit(")")).alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n- … "), F.col("n") - most, F.lit(" more"))).otherwise("")
    return lines.join(n, "kind").select("kind", F.concat(F.lit("## "), "kind", F.lit(" ("), "n", F.lit(")\n"), "lines", more).alias("text"))
