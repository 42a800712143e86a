"""What an intent speaks of: explicit and fuzzy targets in the graph of its project.

docs(doc_id, project, text); files(path, project, zone_name); functions(fn_id, project, file,
fn_name, class_name). Paths in texts stand without the project's folder. Null and empty texts
name nothing; targets are looked up within the document's project; null keys match nothing;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.runtime import Scratch

# Extensions of source files, markers of tests, and the least length of a fuzzy name.
EXTENSIONS = "py|pyi|ts|tsx|js|jsx|mjs|cjs|java|go|rs|cs"
TEST_MARKERS = ["tests/", "test/", "test_", "conftest"]
LEAST_NAME, LEAST_CALL = 4, 3
# Words that speak of taking values away.
REMOVALS = ["simplify", "reduce", "remove", "delete", "consolidate", "shrink", "drop", "prune", "collapse", "merge"]
# Words before a bracket that name no function.
NO_FUNCTIONS = [
    "if", "while", "for", "return", "def", "class", "import", "from", "as", "in", "or", "and", "not", "is", "lambda", "try", "except", "finally", "with", "yield", "raise", "pass", "assert",
    "break", "continue", "global", "nonlocal", "del", "else", "elif", "print", "type", "function", "var", "let", "const", "await", "async", "typeof", "instanceof", "switch", "case", "default",
    "throw", "new", "this", "super", "void", "public", "private", "protected", "static", "final", "extends", "true", "false", "null", "none", "undefined", "use", "using", "see", "note",
]
# How targets are written. Path::name or Path::Class.method; Class.method( ; Class.attribute; name( ; path.
DOUBLE_COLON = rf"[\w./\\-]+\.(?:{EXTENSIONS})::[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?"
CLASS_METHOD = r"\b[A-Z]\w*\.[A-Za-z_]\w*\s*\("
CLASS_ATTRIBUTE = r"\b[A-Z]\w*\.[a-z]\w*\b(?:\s*\()?"
CALL = r"\b[A-Za-z_]\w*\s*\("
PATH = rf"[\w./\\-]+\.(?:{EXTENSIONS})"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def explicit_names(c: Column) -> Column:
    """Names written as path::name, Class.method(, Class.attribute or name(, without those brackets, once each."""
    c = F.coalesce(c, F.lit(""))
    placed = F.transform(_all(c, DOUBLE_COLON), lambda m: F.split_part(m, F.lit("::"), F.lit(2)))
    rest = F.regexp_replace(c, DOUBLE_COLON, " ")
    bare = lambda m: F.regexp_replace(m, r"\s*\($", "")
    methods = F.transform(_all(rest, CLASS_METHOD), bare)
    attributes = F.filter(_all(rest, CLASS_ATTRIBUTE), lambda m: ~m.endswith("("))
    calls = F.filter(F.transform(_all(rest, CALL), bare), lambda m: (F.length(m) >= LEAST_CALL) & ~F.lower(m).isin(NO_FUNCTIONS))
    return F.array_distinct(F.concat(placed, methods, attributes, calls))


def explicit_paths(c: Column) -> Column:
    """Source paths written out in a text, with forward slashes, once each."""
    return F.array_distinct(F.transform(_all(F.coalesce(c, F.lit("")), PATH), lambda m: F.regexp_replace(m, r"\\", "/")))


def explicit_targets(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, target): every explicit name and path of a text."""
    both = F.concat(F.transform(explicit_names(F.col("text")), lambda x: F.struct(F.lit("name").alias("kind"), x.alias("target"))), F.transform(explicit_paths(F.col("text")), lambda x: F.struct(F.lit("path").alias("kind"), x.alias("target"))))
    return docs.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.kind", "x.target")


def within_project(c: str, project: str = "project") -> Column:
    """A path without its project's folder."""
    return F.when(F.col(c).startswith(F.concat(F.col(project), F.lit("/"))), F.expr(f"substring({c}, length({project}) + 2)")).otherwise(F.col(c))


def match_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, project, raw, path): paths of wanted(doc_id, project, raw) in the graph, as written, else in any case, else, for bare names, by the last part (all files of that name)."""
    f = files.select("project", "path", within_project("path").alias("rel"))
    exact = wanted.join(f.select("project", F.col("rel").alias("raw"), "path"), ["project", "raw"])
    left = wanted.join(exact.select("doc_id", "project", "raw"), ["doc_id", "project", "raw"], "left_anti").withColumn("low", F.lower("raw"))
    any_case = left.join(f.groupBy("project", F.lower("rel").alias("low")).agg(F.min("path").alias("path")), ["project", "low"])
    left = left.join(any_case.select("doc_id", "project", "raw"), ["doc_id", "project", "raw"], "left_anti").where(~F.col("raw").contains("/"))
    by_name = left.join(f.select("project", F.lower(F.element_at(F.split("rel", "/"), -1)).alias("low"), "path"), ["project", "low"])
    cols = ["doc_id", "project", "raw", "path"]
    return exact.select(*cols).unionByName(any_case.select(*cols)).unionByName(by_name.select(*cols))


def match_names(wanted: DataFrame, functions: DataFrame) -> DataFrame:
    """(doc_id, project, raw, fn_id, file): functions named by wanted(doc_id, project, raw), as name or Class.method."""
    plain = wanted.where(~F.col("raw").contains(".")).join(functions.select("project", F.col("fn_name").alias("raw"), "fn_id", "file"), ["project", "raw"])
    dotted = wanted.where(F.col("raw").contains(".")).join(functions.where("class_name is not null").select("project", F.concat_ws(".", "class_name", "fn_name").alias("raw"), "fn_id", "file"), ["project", "raw"])
    cols = ["doc_id", "project", "raw", "fn_id", "file"]
    return plain.select(*cols).unionByName(dotted.select(*cols))


def match_attributes(wanted: DataFrame, found: DataFrame, attributes: DataFrame) -> DataFrame:
    """(doc_id, raw, path): Class.attribute names that found (match_names) lacks, in attributes(project, class_name, attr, path)."""
    left = wanted.where(F.col("raw").contains(".")).join(found.select("doc_id", "project", "raw"), ["doc_id", "project", "raw"], "left_anti")
    return left.join(attributes.select("project", F.concat_ws(".", "class_name", "attr").alias("raw"), "path"), ["project", "raw"]).select("doc_id", "raw", "path")


def fuzzy_targets(docs: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """(doc_id, kind, target): zones, files and functions of the project whose name stands in the text as a whole word, in any case.

    The text is cut into words, and into path-like runs with all their tails, once; all are
    joined by hash, so no text meets every name.
    """
    low = F.lower("text")
    words = docs.select("doc_id", "project", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z0-9_]+)"), F.lit(1)))).alias("w")).where(F.length("w") >= LEAST_NAME)
    runs = F.transform(F.regexp_extract_all(low, F.lit(r"([a-z0-9_./-]+)"), F.lit(1)), lambda r: F.regexp_replace(r, r"^[./-]+|[./-]+$", ""))
    tails = F.flatten(F.transform(F.filter(runs, lambda r: r.contains(".")), lambda r: F.transform(F.sequence(F.lit(1), F.size(F.split(r, "/"))), lambda i: F.array_join(F.slice(F.split(r, "/"), i, F.size(F.split(r, "/"))), "/"))))
    paths = docs.select("doc_id", "project", F.explode(F.array_distinct(tails)).alias("w")).where(F.length("w") >= LEAST_NAME)
    zones = words.join(files.select("project", F.lower("zone_name").alias("w"), F.col("zone_name").alias("target")).distinct(), ["project", "w"]).select("doc_id", F.lit("zone").alias("kind"), "target")
    rel = files.select("project", within_project("path").alias("rel"), F.col("path").alias("target"))
    full = rel.select("project", F.lower("rel").alias("w"), "target").unionByName(rel.select("project", F.lower(F.element_at(F.split("rel", "/"), -1)).alias("w"), "target"))
    at = paths.join(full.distinct(), ["project", "w"]).select("doc_id", F.lit("path").alias("kind"), "target")
    named = words.join(functions.select("project", F.lower("fn_name").alias("w"), F.col("fn_id").alias("target")), ["project", "w"]).select("doc_id", F.lit("function").alias("kind"), "target")
    return zones.unionByName(at).unionByName(named).distinct()


def resolve_targets(docs: DataFrame, files: DataFrame, functions: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, target, how): files, functions, zones and attributes an intent names; how is explicit or, where it isn't, fuzzy.

    Files of explicit functions are targets too; a zone stands for its files if the intent
    names no file. Targets in tests are left out unless the text, one of its paths or zones speaks of tests.
    """
    names = docs.select("doc_id", "project", F.explode(explicit_names(F.col("text"))).alias("raw"))
    paths = docs.select("doc_id", "project", F.explode(explicit_paths(F.col("text"))).alias("raw"))
    found = match_names(names, functions)
    parts = [
        match_paths(paths, files).select("doc_id", F.lit("path").alias("kind"), F.col("path").alias("target")),
        found.select("doc_id", F.lit("function").alias("kind"), F.col("fn_id").alias("target")),
        found.select("doc_id", F.lit("path").alias("kind"), F.col("file").alias("target")),
    ]
    if attributes is not None:
        at = match_attributes(names, found, attributes)
        parts += [at.select("doc_id", F.lit("attribute").alias("kind"), F.col("raw").alias("target")), at.select("doc_id", F.lit("path").alias("kind"), F.col("path").alias("target"))]
    explicit = parts[0]
    for p in parts[1:]:
        explicit = explicit.unionByName(p)
    fuzzy = fuzzy_targets(docs, files, functions)
    both = explicit.withColumn("rank", F.lit(0)).unionByName(fuzzy.withColumn("rank", F.lit(1))).groupBy("doc_id", "kind", "target").agg(F.min("rank").alias("rank"))
    both = Scratch(docs.sparkSession, "targets").save(both, "found")  # read four times below; the texts are searched once
    zones = both.where("kind = 'zone'").select("doc_id", F.col("target").alias("zone_name"))
    alone = zones.join(both.where("kind = 'path'").select("doc_id"), "doc_id", "left_anti").join(docs.select("doc_id", "project"), "doc_id")
    of_zone = alone.join(files.select("project", "zone_name", "path"), ["project", "zone_name"]).select("doc_id", F.lit("path").alias("kind"), F.col("path").alias("target"), F.lit(1).alias("rank"))
    both = both.unionByName(of_zone)
    marked = F.lit(False)
    for m in TEST_MARKERS:
        marked = marked | F.lower("text").contains(m)
    tests = docs.where(marked | F.exists(explicit_paths(F.col("text")), T.is_test_path)).select("doc_id").unionByName(zones.where(F.lower("zone_name").contains("test")).select("doc_id")).distinct().withColumn("tests", F.lit(True))
    place = F.when(F.col("kind").isin("path", "function"), T.is_test_path(F.split_part("target", F.lit("::"), F.lit(1)))).otherwise(False)
    kept = both.join(tests, "doc_id", "left").where(F.col("tests") | ~place)
    return kept.groupBy("doc_id", "kind", "target").agg(F.when(F.min("rank") == 0, "explicit").otherwise("fuzzy").alias("how"))


def function_by_name(wanted: DataFrame, functions: DataFrame) -> DataFrame:
    """(raw, fn_id): functions of wanted(raw) by id, else by a name that only one function has."""
    exact = wanted.join(functions.select(F.col("fn_id").alias("raw"), "fn_id"), "raw")
    unique = functions.groupBy(F.col("fn_name").alias("raw")).agg(F.min("fn_id").alias("fn_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return exact.unionByName(wanted.join(exact.select("raw"), "raw", "left_anti").join(unique, "raw").select("raw", "fn_id"))


def shrink_intent(c: Column, removals: list[str]) -> Column:
    """True for a text that speaks, by its stems, of taking values away."""
    stems = F.transform(F.array(*[F.lit(w) for w in removals]), T.stem)
    return F.arrays_overlap(F.transform(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z][a-z0-9]*)"), F.lit(1))), T.stem), stems)
