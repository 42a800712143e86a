"""What a code base does throughout: zones, detectors, collections of values, templates.

Null keys match nothing; empty tables give empty results.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.targets import within_project
from codeloom.sources.scan import _parse, each_file

# Base classes that make no convention.
PLAIN_BASES = ["object", "Exception", "BaseException", "ABC", "Enum"]


def zones(files: DataFrame) -> DataFrame:
    """(path, zone) of files(path, project) below their project's folder.

    A file at the top is its own zone, by its name. Else the zone is the first directory; where
    that one and those below it hold nothing but one directory each, they are passed through:
    the zone is the next directory, or `core` for files directly there. The directories all
    files share are those that the least and the greatest path share.
    """
    f = files.select("path", "project", F.split(within_project("path"), "/").alias("p")).withColumn("d", F.slice("p", 1, F.size("p") - 1)).withColumn("top", F.get("d", F.lit(0)))
    ends = f.where("top is not null").groupBy("project", "top").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    same = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), lambda i: F.slice("lo", 1, i) == F.slice("hi", 1, i)), lambda x: x))
    j = f.join(ends.select("project", "top", same.alias("shared")), ["project", "top"], "left")
    stem = F.regexp_replace(F.get("p", F.lit(0)), r"\.[^.]*$", "")
    zone = F.when(F.col("top").isNull(), stem).when(F.col("shared") <= 1, F.col("top")).when(F.size("d") > F.col("shared"), F.get("d", F.col("shared"))).otherwise("core")
    return j.select("path", zone.alias("zone"))


def python_habits(files: DataFrame) -> DataFrame:
    """(path, habit, name): base classes, functions that return tuples, decorators, fixtures and imported modules of Python files."""

    def extract(path: str, lang: str, text: str) -> list[tuple]:
        tree, rows = _parse(lang, text), []
        for n in ast.walk(tree) if tree else []:
            if isinstance(n, ast.ClassDef):
                rows += [("base", b.id) for b in n.bases if isinstance(b, ast.Name)]
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if any(isinstance(s, ast.Return) and isinstance(s.value, ast.Tuple) for s in n.body):
                    rows.append(("tuple_return", n.name))
                for d in n.decorator_list:
                    name = ast.unparse(d.func if isinstance(d, ast.Call) else d)
                    rows.append(("fixture", n.name) if name.split(".")[-1] == "fixture" else ("decorator", name))
            elif isinstance(n, ast.Import):
                rows += [("module", a.name) for a in n.names]
            elif isinstance(n, ast.ImportFrom) and n.module:
                rows.append(("module", n.module))
        return list(dict.fromkeys(rows))

    return each_file(files, extract, "path string, habit string, name string")


def _spread(habits: DataFrame, habit: str, least: int, category: str, detector: str) -> DataFrame:
    g = habits.where(F.col("habit") == habit).groupBy("name").agg(F.count_distinct("path").alias("n")).where(F.col("n") >= least)
    return g.select(F.lit(category).alias("category"), F.lit(detector).alias("detector"), F.col("name").alias("title"), "n")


def _handlers(habits: DataFrame, internal: DataFrame) -> DataFrame:
    g = habits.where("habit = 'tuple_return'").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    least = F.when(F.lower("path").contains("error"), 1).otherwise(2)
    return g.where(F.col("n") >= least).select(F.lit("errors").alias("category"), F.lit("error_handlers").alias("detector"), F.col("path").alias("title"), "n")


def _fixtures(habits: DataFrame, internal: DataFrame) -> DataFrame:
    g = habits.where("habit = 'fixture'").groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return g.select(F.lit("testing").alias("category"), F.lit("fixtures").alias("detector"), F.col("path").alias("title"), "n")


def _popular(habits: DataFrame, internal: DataFrame) -> DataFrame:
    return _spread(habits.join(internal.select(F.col("module").alias("name")).distinct(), "name", "left_semi"), "module", 3, "architecture", "popular_modules")


#: Detectors by name: functions of (habits, modules of the code base) to rows (category, detector, title, n).
DETECTORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "base_classes": lambda h, m: _spread(h.where(~F.col("name").isin(PLAIN_BASES)), "base", 3, "architecture", "base_classes"),
    "error_handlers": _handlers,
    "decorators": lambda h, m: _spread(h, "decorator", 2, "architecture", "decorators"),
    "fixtures": _fixtures,
    "popular_modules": _popular,
}


def detected_rules(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(category, detector, title, n): what the named detectors (all by default) find in files(path, project, prog_lang, content)."""
    habits = python_habits(files)
    rel = F.regexp_replace(within_project("path"), r"(/__init__)?\.py$", "")
    internal = files.where("prog_lang = 'python'").select(F.regexp_replace(rel, "/", ".").alias("module"))
    out = None
    for n in names or DETECTORS:
        rows = DETECTORS[n](habits, internal)
        out = rows if out is None else out.unionByName(rows)
    return out


def referencing_functions(collections: DataFrame, bodies: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, name, fn_id): functions that speak of a collection of values, collections(path, name).

    A function of bodies(fn_id, file, body) of the same file, or of a file whose import of the
    collection's file (imports(source_file, target_file, names)) names the collection or
    nothing in particular, with the name as a whole word in its body.
    """
    own = collections.select("path", "name", F.col("path").alias("file"))
    far = collections.join(imports.select(F.col("target_file").alias("path"), F.col("source_file").alias("file"), "names"), "path").where((F.size(F.coalesce("names", F.array().cast("array<string>"))) == 0) | F.array_contains("names", F.col("name"))).select("path", "name", "file")
    words = bodies.select("fn_id", "file", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))).alias("name"))
    return own.unionByName(far).distinct().join(words, ["file", "name"]).select("path", "name", "fn_id").distinct()


def value_changes(before: DataFrame, after: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, name, added, removed, affected_uses, files_at_risk): collections(path, name, values) whose values changed; collections that vanish whole are not reported.

    uses(path, name, value, fn_id) are the calls before the change that pass a value to a function of the collection.
    """
    j = before.select("path", "name", F.col("values").alias("b")).join(after.select("path", "name", F.col("values").alias("a")), ["path", "name"])
    j = j.withColumns({"added": F.array_sort(F.array_except("a", "b")), "removed": F.array_sort(F.array_except("b", "a"))}).where((F.size("added") > 0) | (F.size("removed") > 0))
    hit = j.select("path", "name", F.explode("removed").alias("value")).join(uses, ["path", "name", "value"]).groupBy("path", "name").agg(F.count(F.lit(1)).alias("affected_uses"), F.count_distinct(F.split_part("fn_id", F.lit("::"), F.lit(1))).alias("files_at_risk"))
    return j.join(hit, ["path", "name"], "left").fillna(0, ["affected_uses", "files_at_risk"]).select("path", "name", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"), "affected_uses", "files_at_risk")


def rendered_templates(handlers: DataFrame) -> DataFrame:
    """(fn_id, file, template): the first template that the body of a route handler(fn_id, file, body) renders."""
    t = F.regexp_extract("body", r"""render_template\(\s*["']([^"']+)["']""", 1)
    return handlers.select("fn_id", "file", t.alias("template")).where("template <> ''")


def template_files(handlers: DataFrame, templates: DataFrame) -> DataFrame:
    """(fn_id, template, path, tier): the file of templates(path) for each template a handler(fn_id, file, template) renders.

    Tier 1: the path itself; 2: below templates/; 3: a path that ends in it, of several the one
    that shares the longest beginning with the handler's directory, then the smallest.
    """
    h = handlers.where("template is not null")
    t = templates.select(F.col("path").alias("p"))
    exact = h.join(t, F.col("template") == F.col("p")).select("fn_id", "file", "template", "p", F.lit(1).alias("tier"))
    below = h.join(t, F.concat(F.lit("templates/"), "template") == F.col("p")).select("fn_id", "file", "template", "p", F.lit(2).alias("tier"))
    # by hash on the last part of the path, then the rest of the name
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    ends = h.withColumn("k", last("template")).join(t.withColumn("k", last("p")), "k").where(F.col("p").endswith(F.concat(F.lit("/"), "template"))).select("fn_id", "file", "template", "p", F.lit(3).alias("tier"))
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    n = F.least(F.length(folder), F.length("p"))
    lcp = F.size(F.filter(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(folder, F.lit(1), i) == F.substring("p", F.lit(1), i)), lambda x: x))
    rows = exact.unionByName(below).unionByName(ends)
    best = rows.withColumn("n", F.row_number().over(W.partitionBy("fn_id", "template").orderBy("tier", F.desc(lcp), "p"))).where("n = 1")
    return best.select("fn_id", "template", F.col("p").alias("path"), "tier")
