"""The answers agents ask for, put together from the other operators.

Every answer is a relation for all intents, functions or transitions at once; a caller keeps
the rows it asked for. Null keys match nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import graph as G
from codeloom.operators.search import FLOOR, GAP, HARD


def before_create(targets: DataFrame, docs: DataFrame, file_facts: DataFrame, function_facts: DataFrame, category) -> DataFrame:
    """(doc_id, category, shrinks, kind, target, how, importers, migration_cost, locked_fns, callers, caller_files, test_callers): what stands at each target of an intent.

    targets as targets.resolve_targets; file_facts and function_facts as graph.files_block and
    graph.functions_block; category(column) and the shrinking test come from the text.
    """
    from codeloom.operators.targets import REMOVALS, shrink_intent

    head = docs.select("doc_id", category(F.col("text")).alias("category"), shrink_intent(F.col("text"), REMOVALS).alias("shrinks"))
    files = file_facts.select(F.lit("path").alias("kind"), F.col("file").alias("target"), "importers", "migration_cost", "locked_fns")
    fns = function_facts.select(F.lit("function").alias("kind"), F.col("fn_id").alias("target"), "callers", "caller_files", "test_callers")
    rows = targets.join(head, "doc_id").join(files, ["kind", "target"], "left").join(fns, ["kind", "target"], "left")
    counts = ["importers", "migration_cost", "locked_fns", "callers", "caller_files", "test_callers"]
    return rows.fillna(0, counts).select("doc_id", "category", "shrinks", "kind", "target", "how", *counts)


def scope(functions: DataFrame, edges: DataFrame, files: DataFrame, imports: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per function: signature, zone, route marker, callers, callees, files of its zone that import its file, whether the start reaches its file, functions with a shared tag, and risk."""
    zone = files.select(F.col("path").alias("file"), F.coalesce("zone_name", F.lit("unknown")).alias("zone"))
    z2 = zone.select(F.col("file").alias("source_file"), F.col("zone").alias("source_zone"))
    siblings = imports.join(z2, "source_file").join(zone.withColumnRenamed("file", "target_file"), "target_file").where("zone = source_zone").groupBy(F.col("target_file").alias("file")).agg(F.count_distinct("source_file").alias("siblings"))
    start = G.bounded_bfs(imports, G.entry_points(files), 2).select(F.col("path").alias("file")).distinct().withColumn("in_startup", F.lit(True))
    f = functions.select("fn_id", "file", T.signature(F.col("params"), F.col("return_type")).alias("signature"), route_marker("http_method", "route").alias("marker"))
    f = f.join(zone, "file", "left").join(siblings, "file", "left").join(start, "file", "left")
    f = f.join(G.callers_degree(edges), "fn_id", "left").join(G.callees_degree(edges), "fn_id", "left").join(G.similar_logic(functions).select("fn_id", "n_similar"), "fn_id", "left").join(G.risk_view(functions, reports), "fn_id", "left")
    f = f.fillna(0, ["siblings", "callers", "callees", "n_similar"]).fillna(False, ["in_startup"])
    return f.select("fn_id", "signature", "marker", F.coalesce("zone", F.lit("unknown")).alias("zone"), "callers", "callees", "siblings", "in_startup", "n_similar", "risk_level")


def route_marker(method: str, route: str):
    """[METHOD /path] of a route, empty where there is none."""
    return F.when(F.col(route).isNotNull(), F.concat(F.lit("["), F.coalesce(method, F.lit("GET")), F.lit(" "), route, F.lit("]"))).otherwise("")


def impact_check(signatures: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """(*keys, warning, severity, target, detail) of what a step of the graph breaks.

    signatures(*keys, fn_id, change, note, callers): a function removed or changed but not
    additively, with callers, is an error. values(*keys, path, added, removed): values taken
    away are a warning.
    """
    broken = signatures.where((F.col("callers") > 0) & ((F.col("change") == "removed") | (F.col("note") == "breaking")))
    a = broken.select(*keys, F.lit("broken_caller").alias("warning"), F.lit("error").alias("severity"), F.col("fn_id").alias("target"), F.col("change").alias("detail"))
    b = values.where("removed <> ''").select(*keys, F.lit("value_locked").alias("warning"), F.lit("warning").alias("severity"), F.col("path").alias("target"), F.col("removed").alias("detail"))
    return a.unionByName(b)


def value_warnings(removed: DataFrame, uses: DataFrame, repo_hits: DataFrame, hook: bool = False) -> DataFrame:
    """(name, value, uses, hits, severity): values taken out of collections; an error if a call still uses the value or, for the write hook, if it stands anywhere in the repository.

    removed(name, value), uses(value, uses), repo_hits(value, hits).
    """
    r = removed.join(uses, "value", "left").join(repo_hits, "value", "left").fillna(0, ["uses", "hits"])
    bad = (F.col("uses") > 0) | (F.lit(hook) & (F.col("hits") > 0))
    return r.select("name", "value", "uses", "hits", F.when(bad, "error").otherwise("warning").alias("severity"))


def find_work_area(top: DataFrame, units: DataFrame, functions: DataFrame, clip: int = 250) -> DataFrame:
    """(query_id, rank, id, score, kind, name, file, description, verdict, confidence): the hits of each query with what is known of them; a hit without unit has kind unknown.

    top(query_id, id, score); the verdict is that of the query's best score and its gap to the last.
    """
    w = W.partitionBy("query_id")
    t = top.select("query_id", "id", "score", F.row_number().over(w.orderBy(F.desc("score"), "id")).alias("rank"), F.max("score").over(w).alias("best"), F.min("score").over(w).alias("last"))
    ok = (F.col("best") >= HARD) | ((F.col("best") >= FLOOR) & (F.col("best") - F.col("last") >= GAP))
    u = units.select("id", "kind", F.col("unit_name").alias("name"), F.substring("description", 1, clip).alias("description"))
    f = functions.select(F.col("fn_id").alias("id"), "file")
    rows = t.join(u, "id", "left").join(f, "id", "left")
    return rows.select(
        "query_id", "rank", "id", "score", F.coalesce("kind", F.lit("unknown")).alias("kind"), "name", "file", "description",
        F.when(ok, "OK").otherwise("NO_CLEAR_MATCH").alias("verdict"), F.when(F.col("best") >= HARD, "high").when(ok, "medium").otherwise("low").alias("confidence"),
    )


def token_estimate(c):
    """Tokens a text is taken to have: a quarter of its characters."""
    return F.floor(F.length(c) / 4)


def orient(sections: list[tuple[str, DataFrame]], budget: int, reserve: int = 200) -> DataFrame:
    """(section, pos, rows, tokens, how): which of the sections(name, lines(line)), in their order of priority, fit into a budget of tokens.

    A section that doesn't fit whole is taken in short (its first tenth, at least one line) if
    that fits, else skipped; `reserve` tokens are kept for the last section. At most a handful
    of sections, whose sizes are one aggregate each.
    """
    sizes = None
    for i, (name, lines) in enumerate(sections):
        n = lines.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(token_estimate(F.col("line")) + 1), F.lit(0)).alias("tokens")).select(F.lit(name).alias("section"), F.lit(i).alias("pos"), "rows", "tokens")
        sizes = n if sizes is None else sizes.unionByName(n)
    last = len(sections) - 1
    item = F.struct("pos", "section", "rows", "tokens")
    start = F.struct(F.array().cast("array<struct<pos:int,section:string,rows:bigint,tokens:bigint,how:string>>").alias("out"), F.lit(0).cast("bigint").alias("used"))

    def step(acc, s):
        room = F.lit(budget) - acc["used"] - F.when(s["pos"] < last, F.least(F.lit(reserve), F.lit(budget))).otherwise(0)
        short = F.ceil(s["tokens"] / 10).cast("bigint")
        how = F.when(s["tokens"] <= room, "full").when(short <= room, "short").otherwise("skipped")
        cost = F.when(how == "full", s["tokens"]).when(how == "short", short).otherwise(F.lit(0).cast("bigint"))
        row = F.struct(s["pos"].alias("pos"), s["section"].alias("section"), s["rows"].alias("rows"), s["tokens"].alias("tokens"), how.alias("how"))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), (acc["used"] + cost).cast("bigint").alias("used"))

    all_of = sizes.agg(F.array_sort(F.collect_list(item)).alias("xs"))  # one entry per section
    return all_of.select(F.explode(F.aggregate("xs", start, step)["out"]).alias("x")).select("x.section", "x.pos", "x.rows", "x.tokens", "x.how")


def sync_gaps(warnings: DataFrame, rules: DataFrame, modified: DataFrame) -> DataFrame:
    """(rule, missing): for warnings(text) that name a Rule #n, the files the rule asks to change together that modified(path) lacks."""
    named = warnings.select(F.regexp_extract("text", r"Rule #(\d+)", 1).try_cast("int").alias("id")).where("id is not null").distinct()
    files = rules.select(F.col("id").cast("int").alias("id"), F.explode("sync_with").alias("path")).join(named, "id")
    return files.join(modified.select("path").distinct(), "path", "left_anti").groupBy(F.col("id").alias("rule")).agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("missing"))
