"""Operators on the code graph: degrees, neighbourhoods, imports, resolution, zones, debt.

Inputs are DataFrames functions(fn_id, project, file, fn_name, ...), edges(project, source_fn,
target_fn, site_file, line, expression, confidence), files(path, project, zone_name, imports,
function_ids, ...) and imports(project, source_file, target_file). Rows with null keys join
nothing; empty inputs give empty results (totals: one row of zeros). Input columns other than
those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.ordering import numbered
from codeloom.operators.skew import hot_keys, lookup_join

# File names that start a program.
ENTRY_POINTS = ["app.py", "main.py", "manage.py", "wsgi.py", "asgi.py", "__main__.py", "server.py", "run.py"]


def file_of(c: str) -> Column:
    return F.split_part(F.col(c), F.lit("::"), F.lit(1))


def callers_degree(edges: DataFrame) -> DataFrame:
    """(fn_id, callers): calls per called function; partial sums before the shuffle tame hot targets."""
    return edges.groupBy(F.col("target_fn").alias("fn_id")).agg(F.count(F.lit(1)).alias("callers"))


def callees_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source_fn").alias("fn_id")).agg(F.count(F.lit(1)).alias("callees"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(fn_id, degree): calls in and out; a call of itself counts twice."""
    ends = edges.select(F.explode(F.array("source_fn", "target_fn")).alias("fn_id"))
    return ends.groupBy("fn_id").agg(F.count(F.lit(1)).alias("degree"))


def with_callers(functions: DataFrame, edges: DataFrame) -> DataFrame:
    return functions.drop("callers").join(callers_degree(edges), "fn_id", "left").fillna(0, ["callers"])


def graph_totals(functions: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, functions, edges and the languages in order."""
    f = files.agg(F.count(F.lit(1)).alias("n_files"))
    g = functions.agg(F.count(F.lit(1)).alias("n_functions"), F.array_join(F.array_sort(F.collect_set("prog_lang")), ",").alias("languages"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return f.crossJoin(g).crossJoin(e)  # three one-row aggregates


def hotspots(functions: DataFrame, edges: DataFrame, least: int = 1, limit: int | None = None) -> DataFrame:
    """Functions with at least `least` callers, most called first, ties by id; optionally the first `limit`."""
    hot = callers_degree(edges).where(F.col("callers") >= least).join(functions.select("fn_id", "file", "fn_name"), "fn_id")
    hot = hot.select("fn_id", "file", "fn_name", "callers").orderBy(F.desc("callers"), "fn_id")
    return hot.limit(limit) if limit else hot


def locked_functions(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with at least one caller."""
    return functions.join(edges.select(F.col("target_fn").alias("fn_id")), "fn_id", "left_semi").select("fn_id", "file", "fn_name")


def orphan_functions(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions nobody calls."""
    return functions.join(edges.select(F.col("target_fn").alias("fn_id")), "fn_id", "left_anti").select("fn_id", "file")


def resolve_imports(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(project, source_file, target_file) from the import statements of files, within a project.

    imp.module names a file by its dotted path (of several the last path counts), imp.name the
    first function of that name in another file. Self-imports are left out.
    """
    raw = files.select("project", "path", F.explode("imports").alias("x")).select("project", "path", F.col("x.capture").alias("capture"), F.col("x.text").alias("text")).distinct()
    dotted = F.regexp_replace(F.regexp_replace(F.expr("substring(path, length(project) + 2)"), r"\.[^.]*$", ""), "/", ".")
    stems = files.select("project", dotted.alias("text"), "path").groupBy("project", "text").agg(F.max("path").alias("target_file"))
    modules = raw.where("capture = 'imp.module'").join(stems, ["project", "text"]).select("project", F.col("path").alias("source_file"), "target_file")
    # of any name the two first files suffice: one of them isn't the importing file
    first = _first_two(functions.select("project", F.col("fn_name").alias("text"), "file"), ["project", "text"], "file")
    names = raw.where("capture = 'imp.name'").join(first, ["project", "text"])
    names = names.select("project", F.col("path").alias("source_file"), F.when(F.col("one") != F.col("path"), F.col("one")).otherwise(F.col("two")).alias("target_file"))
    return modules.unionByName(names.where("target_file is not null")).where("source_file <> target_file").distinct()


def _first_two(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, one, two): the two smallest different values of each key; partial aggregates, so no key's values are collected."""
    least = rows.groupBy(*keys).agg(F.min(value).alias("one"))
    rest = rows.join(least, keys).where(F.col(value) != F.col("one")).groupBy(*keys).agg(F.min(value).alias("two"))
    return least.join(rest, keys, "left")


def zone_map(functions: DataFrame, edges: DataFrame, files: DataFrame, startup: DataFrame | None = None) -> DataFrame:
    """Per zone: files, functions, routes and functions with callers; with startup(path) the files that the start reaches as well."""
    z = files.select(F.col("path").alias("file"), F.coalesce("zone_name", F.lit("unknown")).alias("zone"))
    f = z.groupBy("zone").agg(F.count(F.lit(1)).alias("n_files"))
    rows = with_callers(functions.select("fn_id", "file", "route"), edges).join(z, "file")
    g = rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n_functions"), F.count("route").alias("n_routes"), F.count_if(F.col("callers") > 0).alias("n_locked"))
    out = f.join(g, "zone", "left").fillna(0, ["n_functions", "n_routes", "n_locked"])
    if startup is None:
        return out
    s = z.join(startup.select(F.col("path").alias("file")).distinct(), "file", "left_semi").groupBy("zone").agg(F.count(F.lit(1)).alias("n_startup"))
    return out.join(s, "zone", "left").fillna(0, ["n_startup"])


def zone_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_zone, to_zone, n): imports that cross zones."""
    z = files.select("path", F.coalesce("zone_name", F.lit("unknown")).alias("zone"))
    rows = imports.join(z.select(F.col("path").alias("source_file"), F.col("zone").alias("from_zone")), "source_file").join(z.select(F.col("path").alias("target_file"), F.col("zone").alias("to_zone")), "target_file")
    return rows.where("from_zone <> to_zone").groupBy("from_zone", "to_zone").agg(F.count(F.lit(1)).alias("n"))


def mutual_imports(imports: DataFrame) -> DataFrame:
    """(file_a, file_b), file_a < file_b: files that import each other. One pass: both directions of a pair meet in one group."""
    pair = imports.select(F.least("source_file", "target_file").alias("file_a"), F.greatest("source_file", "target_file").alias("file_b"), (F.col("source_file") < F.col("target_file")).alias("up"))
    both = pair.groupBy("file_a", "file_b").agg(F.max("up").alias("hi"), F.min("up").alias("lo"))
    return both.where("hi and not lo").select("file_a", "file_b")


def named_calls(edges: DataFrame) -> DataFrame:
    """(project, source_fn, file, callee) of written edges, for another resolution."""
    return edges.select("project", "source_fn", file_of("source_fn").alias("file"), F.split_part("target_fn", F.lit("::"), F.lit(2)).alias("callee")).distinct()


def imported_names(files: DataFrame) -> DataFrame:
    """(file, callee): the names that files import."""
    return files.select(F.col("path").alias("file"), F.explode("imports").alias("x")).where("x.capture = 'imp.name'").select("file", F.col("x.text").alias("callee")).distinct()


def resolve_calls(calls: DataFrame, functions: DataFrame, imported: DataFrame) -> DataFrame:
    """(source_fn, callee, target_fn, confidence): calls(project, source_fn, file, callee) resolved by name in three tiers.

    A name that the file imports (imported(file, callee)) and another file defines (1.0), a
    function of the same file (0.95), a name unique in the project (0.5); other calls are dropped.
    """
    named = functions.select("project", "file", F.col("fn_name").alias("callee"), "fn_id").distinct()
    first = _first_two(named, ["project", "callee"], "fn_id")  # ids of one name differ by their file
    other = F.when(file_of("one") != F.col("file"), F.col("one")).otherwise(F.col("two"))
    tier1 = calls.select("project", "file", "callee").distinct().join(imported, ["file", "callee"]).join(first, ["project", "callee"]).select("file", "callee", other.alias("t1")).where("t1 is not null")
    tier2 = named.groupBy("file", "callee").agg(F.min("fn_id").alias("t2"))
    tier3 = first.where("two is null").select("project", "callee", F.col("one").alias("t3"))
    got = calls.join(tier1, ["file", "callee"], "left").join(tier2, ["file", "callee"], "left").join(tier3, ["project", "callee"], "left")
    confidence = F.when(F.col("t1").isNotNull(), 1.0).when(F.col("t2").isNotNull(), 0.95).otherwise(0.5)
    return got.select("source_fn", "callee", F.coalesce("t1", "t2", "t3").alias("target_fn"), confidence.alias("confidence")).where("target_fn is not null")


def enclosed_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls(path, line, ...) with the project and source_fn of every function whose lines hold them: an interval join within each file."""
    spans = functions.select("project", F.col("fn_id").alias("source_fn"), F.col("file").alias("path"), "line_start", "line_end")
    return calls.join(spans, "path").where("line between line_start and line_end").drop("line_start", "line_end")


def edges_from_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame, attributes: DataFrame) -> DataFrame:
    """(project, source_fn, target_fn, site_file, line, expression, confidence) from calls(path, callee, receiver, line, expression) read from source.

    A call without receiver, or on an imported module, is resolved by name; one on self.attr by
    the class the attribute was given in __init__; calls on anything else are dropped.
    functions(fn_id, project, file, fn_name, class_name, line_start, line_end),
    imports(path, capture, text), attributes as scan.init_attributes.
    """
    sites = enclosed_calls(calls, functions)
    modules = imports.where("capture = 'imp.module'").select("path", F.regexp_extract("text", r"([\w$]+)\W*$", 1).alias("receiver"), F.lit(True).alias("module")).distinct()
    told = sites.join(modules, ["path", "receiver"], "left")
    plain = told.where("receiver is null or module").drop("module", "receiver")
    by_name = resolve_calls(plain.select("project", "source_fn", F.col("path").alias("file"), "callee").distinct(), functions, imports.where("capture = 'imp.name'").select(F.col("path").alias("file"), F.col("text").alias("callee")).distinct())
    out = plain.join(by_name, ["source_fn", "callee"])
    own = attribute_targets(attributes, functions).select(F.col("fn_id").alias("source_fn"), F.concat(F.lit("self."), "attr").alias("receiver"), "target_fn", "confidence")
    by_attr = sites.join(own, ["source_fn", "receiver"]).where(F.split_part("target_fn", F.lit("::"), F.lit(2)) == F.col("callee"))
    cols = ["project", "source_fn", "target_fn", F.col("path").alias("site_file"), "line", "expression", "confidence"]
    rows = out.select(*cols).unionByName(by_attr.select(*cols))
    return rows.groupBy("project", "source_fn", "target_fn", "site_file", "line", "expression").agg(F.max("confidence").alias("confidence"))


def upgrade_confidence(edges: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source_fn, target_fn, confidence, upgraded): calls under 0.9 between files that import each other gain: 0.95 if the name is imported, else at least 0.85."""
    e = edges.select("source_fn", "target_fn", "confidence", file_of("source_fn").alias("source_file"), file_of("target_fn").alias("target_file"), F.split_part("target_fn", F.lit("::"), F.lit(2)).alias("callee"))
    e = e.groupBy("source_fn", "target_fn", "source_file", "target_file", "callee").agg(F.max("confidence").alias("confidence"))
    pair = imports.select("source_file", "target_file", F.lit(True).alias("linked")).distinct()
    names = files.select(F.col("path").alias("source_file"), F.explode("imports").alias("x")).where("x.capture = 'imp.name'").select("source_file", F.col("x.text").alias("callee"), F.lit(True).alias("named")).distinct()
    j = e.join(pair, ["source_file", "target_file"], "left").join(names, ["source_file", "callee"], "left")
    up = F.when((F.col("confidence") < 0.9) & F.col("linked") & F.col("named"), 0.95).when((F.col("confidence") < 0.9) & F.col("linked"), F.greatest("confidence", F.lit(0.85))).otherwise(F.col("confidence"))
    return j.select("source_fn", "target_fn", "confidence", up.alias("upgraded"))


def attribute_targets(attributes: DataFrame, functions: DataFrame) -> DataFrame:
    """(fn_id, attr, target_class, target_fn, confidence): what a call self.attr.method() within a method resolves to, 0.85 each.

    attributes(path, class_name, attr, target_class, target_file) as scan.init_attributes
    gives them; functions(fn_id, file, fn_name, class_name). No inheritance and one level only.
    """
    callers = functions.where("class_name is not null").select("fn_id", "class_name", F.col("file").alias("path"))
    targets = functions.select(F.col("class_name").alias("target_class"), F.col("file").alias("target_file"), F.col("fn_id").alias("target_fn"))
    own = callers.join(attributes, ["path", "class_name"])
    return own.join(targets, ["target_class", "target_file"]).select("fn_id", "attr", "target_class", "target_fn", F.lit(0.85).alias("confidence")).distinct()


def enclosing_functions(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(site_file, line, fn_id): call sites and every function of the file whose lines hold them."""
    sites = edges.select("site_file", "line").distinct()
    spans = functions.select(F.col("file").alias("site_file"), "fn_id", "line_start", "line_end")
    return sites.join(spans, "site_file").where("line between line_start and line_end").select("site_file", "line", "fn_id")


def neighbourhood(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """(centre, side, fn_id): direct callers (up) and callees (down) of centres(fn_id)."""
    c = centres.select(F.col("fn_id").alias("centre")).distinct()
    up = edges.join(c, edges["target_fn"] == c["centre"]).select("centre", F.lit("up").alias("side"), F.col("source_fn").alias("fn_id"))
    down = edges.join(c, edges["source_fn"] == c["centre"]).select("centre", F.lit("down").alias("side"), F.col("target_fn").alias("fn_id"))
    return up.unionByName(down).distinct()


def bounded_bfs(imports: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, path, depth): files within `depth` imports of roots(root), at their least depth."""
    step = imports.select(F.col("source_file").alias("path"), F.col("target_file").alias("to")).distinct()
    seen = roots.select("root", F.col("root").alias("path"), F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        front = front.join(step, "path").select("root", F.col("to").alias("path"), F.lit(d).alias("depth")).distinct().join(seen.select("root", "path"), ["root", "path"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def entry_points(files: DataFrame) -> DataFrame:
    """(project, root): per project the first path named like an entry point, else its first path."""
    named = F.element_at(F.split("path", "/"), -1).isin(ENTRY_POINTS)
    return files.groupBy("project").agg(F.coalesce(F.min(F.when(named, F.col("path"))), F.min("path")).alias("root"))


def debt_items(functions: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """(category, severity, target, value): complexity, long functions, monster files, circular imports."""

    def graded(df: DataFrame, category: str, target: str, value: Column, high: int, medium: int) -> DataFrame:
        return df.select(F.lit(category).alias("category"), F.when(value >= high, "high").when(value >= medium, "medium").alias("severity"), F.col(target).alias("target"), value.cast("long").alias("value")).where("severity is not null")

    out = graded(functions, "complexity", "fn_id", F.col("complexity"), 15, 10).unionByName(graded(functions, "long_function", "fn_id", F.col("line_count"), 100, 50))
    out = out.unionByName(graded(files, "monster_file", "path", F.coalesce(F.size("function_ids"), F.lit(0)), 30, 15))
    cyc = mutual_imports(imports).select(F.lit("circular_import").alias("category"), F.lit("medium").alias("severity"), F.concat_ws(" <-> ", "file_a", "file_b").alias("target"), F.lit(0).cast("long").alias("value"))
    return out.unionByName(cyc)


def debt_summary(items: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: items by severity, score = 3 high + medium, and density per 100 functions."""
    s = items.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    n = functions.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    score = F.col("high") * 3 + F.col("medium")
    return s.crossJoin(n).select("total", "high", "medium", score.alias("score"), T.round_half_up(score * 100.0 / F.col("n"), 1).alias("density"))


def files_block(functions: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Per file: importers, calls from other files, functions with callers, of these with callers outside tests."""
    importers = imports.groupBy(F.col("target_file").alias("file")).agg(F.count_distinct("source_file").alias("importers"))
    e = edges.select("target_fn", file_of("target_fn").alias("file"), file_of("source_fn").alias("from_file"))
    calls = e.groupBy("file").agg(
        F.count_if(F.col("from_file") != F.col("file")).alias("migration_cost"), F.count_distinct("target_fn").alias("locked_fns"),
        F.count_distinct(F.when(~T.is_test_path(F.col("from_file")), F.col("target_fn"))).alias("prod_locked"),
    )
    rows = functions.select("file").distinct().join(importers, "file", "left").join(calls, "file", "left")
    return rows.fillna(0, ["importers", "migration_cost", "locked_fns", "prod_locked"])


def functions_block(edges: DataFrame) -> DataFrame:
    """Per called function: callers, distinct calling files, calls from tests."""
    src = file_of("source_fn")
    return edges.groupBy(F.col("target_fn").alias("fn_id")).agg(F.count(F.lit(1)).alias("callers"), F.count_distinct(src).alias("caller_files"), F.count_if(T.is_test_path(src)).alias("test_callers"))


def page(functions: DataFrame, edges: DataFrame, zone: str, files: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of the functions of a zone or path prefix, by id."""
    z = files.select(F.col("path").alias("file"), F.col("zone_name"))
    rows = with_callers(functions.select("fn_id", "fn_name", "file"), edges).join(z, "file").where((F.col("zone_name") == zone) | (F.col("file") == zone) | F.col("file").startswith(zone.rstrip("/") + "/"))
    return rows.select("fn_id", "fn_name", "callers").orderBy("fn_id").offset(offset).limit(limit)


def graph_index(functions: DataFrame, edges: DataFrame, block: int = 1000) -> DataFrame:
    """(project, pos, fn_id, block, callers): functions numbered per project by id, and the numbers of their callers in the project in order, one row per block of numbers that holds some.

    A function without callers has one row with empty callers, in block 0.
    """
    num = numbered(functions.select("project", "fn_id"), "project", [F.col("fn_id")], "pos")
    hot = hot_keys(edges, "source_fn")
    calls = lookup_join(edges.select("source_fn", "target_fn").distinct(), num.select(F.col("fn_id").alias("source_fn"), F.col("pos").alias("p"), F.col("project").alias("sp")), "source_fn", hot)
    who = calls.groupBy(F.col("target_fn").alias("fn_id"), F.col("sp").alias("project"), F.floor(F.col("p") / block).cast("int").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x.cast("string")), ",").alias("callers"))
    return num.join(who, ["project", "fn_id"], "left").select("project", "pos", "fn_id", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("callers", F.lit("")).alias("callers"))


def routes(functions: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """Functions with a route and the first `most` functions they call, in order."""
    calls = edges.select(F.col("source_fn").alias("fn_id"), "target_fn").distinct().withColumn("n", F.row_number().over(W.partitionBy("fn_id").orderBy("target_fn"))).where(F.col("n") <= most)
    out = calls.groupBy("fn_id").agg(F.array_join(F.array_sort(F.collect_list("target_fn")), ",").alias("callees"))
    return functions.where("route is not null").select("fn_id", "file", "http_method", "route").join(out, "fn_id", "left").select("file", "route", "http_method", "fn_id", F.coalesce("callees", F.lit("")).alias("callees"))


def data_flow_targets(functions: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """Per project the routes of highest degree (a quarter of the places) and the best connected other functions."""
    rows = functions.select("project", "fn_id", "fn_name", "route").join(degree_centrality(edges), "fn_id", "left").fillna(0, ["degree"])
    quota = max(1, most // 4)
    w = W.partitionBy("project").orderBy(F.desc("degree"), "fn_id")
    r = rows.where("route is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= quota).select("project", "fn_id", "degree", F.lit(0).alias("tier"))
    rest = rows.where(~F.col("fn_name").startswith("_") & (F.col("degree") > 0)).join(r.select("fn_id"), "fn_id", "left_anti").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("project", "fn_id", "degree", F.lit(1).alias("tier"))
    both = r.unionByName(rest).withColumn("n", F.row_number().over(W.partitionBy("project").orderBy("tier", F.desc("degree"), "fn_id")))
    return both.where(F.col("n") <= most).select("project", "n", "fn_id", "degree")


def similar_logic(functions: DataFrame) -> DataFrame:
    """(fn_id, n_similar, tags): functions that share a secondary intent with others, counted per tag group without pairing rows."""
    tags = functions.select("fn_id", F.explode("secondary_intents").alias("tag")).distinct()
    size = tags.groupBy("tag").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return tags.join(size, "tag").groupBy("fn_id").agg(F.sum("others").alias("n_similar"), F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


def exact_clones(functions: DataFrame) -> DataFrame:
    """(fn_id, clone_class, n_links): functions with equal AST hash; the class is named by its smallest id."""
    rows = functions.where("ast_hash is not null").select("fn_id", "ast_hash")
    sizes = rows.groupBy("ast_hash").agg(F.min("fn_id").alias("clone_class"), (F.count(F.lit(1)) - 1).alias("n_links")).where("n_links > 0")
    return rows.join(sizes, "ast_hash").select("fn_id", "clone_class", "n_links")


def near_clone_names(functions: DataFrame, least: float = 0.7) -> DataFrame:
    """(name_a, name_b, jaccard): distinct token sets of function names with Jaccard `least` or more.

    Exact: two sets with Jaccard t share a token among the first |s| - ceil(t |s|) + 1 of the
    rarest-first order, so only these prefix tokens are joined; a token that many sets hold is
    in few prefixes. Names with equal sets are one class and don't pair.
    """
    sets = functions.select(F.array_sort(F.array_distinct(T.split_identifier(F.col("fn_name")))).alias("ws")).where(F.size("ws") > 0).distinct().withColumn("key", F.array_join("ws", " "))
    words = sets.select("key", F.explode("ws").alias("w"))
    freq = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    order = words.join(freq, "w").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    prefix = order.select("key", F.transform("o", lambda x: x["w"]).alias("ws")).withColumn("n", F.size("ws"))
    prefix = prefix.withColumn("p", F.slice("ws", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")))
    a = prefix.select(F.col("key").alias("name_a"), F.col("ws").alias("wa"), F.explode("p").alias("w"))
    b = prefix.select(F.col("key").alias("name_b"), F.col("ws").alias("wb"), F.explode("p").alias("w"))
    near = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    close = (F.size("wa") >= F.size("wb") * least) & (F.size("wb") >= F.size("wa") * least)
    pairs = a.join(b, "w").where((F.col("name_a") < F.col("name_b")) & close).select("name_a", "name_b", T.round_half_up(near, 4).alias("jaccard"), near.alias("x"))
    return pairs.where(F.col("x") >= least - 1e-12).drop("x").distinct()


def name_prefixes(functions: DataFrame, most: int = 5) -> DataFrame:
    """Per project the commonest first words of names (at least twice), at most `most`."""
    first = functions.select("project", T.split_identifier(F.col("fn_name"))[0].alias("word")).where("word is not null")
    n = first.groupBy("project", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return n.withColumn("r", F.row_number().over(W.partitionBy("project").orderBy(F.desc("n"), "word"))).where(F.col("r") <= most).select("project", "word", "n")


def median_function(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project the function in the upper middle by callers (ties by id)."""
    rows = with_callers(functions.select("project", "fn_id"), edges).select("project", "fn_id", "callers")
    n = rows.groupBy("project").agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("middle"))
    r = numbered(rows, "project", [F.col("callers"), F.col("fn_id")], "r").join(n, "project")
    return r.where("r = middle").select("project", "fn_id", "callers")


def risk_view(functions: DataFrame, reports: DataFrame) -> DataFrame:
    """(fn_id, risk_level, risk_score): functions with the risk of their newest impact report; null where there is none."""
    last = reports.groupBy("fn_id").agg(F.max_by(F.struct("risk_level", "risk_score"), "generated_at").alias("r")).select("fn_id", "r.*")
    return functions.select("fn_id").join(last, "fn_id", "left")


def edge_source(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a written graph (see sources.store)."""
    return spark.read.parquet(f"{path}/edges")
