"""Queries over source texts, compared with the graph tables where these hold the same facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.keys import plain_key
from codeloom.operators import graph as G
from codeloom.plans.views import BASE, Graph, latest, sql_key
from codeloom.runtime import table
from codeloom.sources import facts, scan

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return add


def _files(spark, root):
    """Current text of every source file: of repeated paths the row read last."""
    f = table(spark, root, "source_files").select(plain_key(F.col("path")).alias("path"), F.trim("project").alias("project"), F.col("read_at").alias("loaded_at"), "content").where("path is not null")
    f = latest(f, ["path"], ["project", "content"])
    return f.select("path", "project", scan.language_of(F.col("path")).alias("prog_lang"), "content")


def _functions(files):
    return facts.functions(files).withColumn("fn_id", F.concat("path", F.lit("::"), "fn_name")).join(files.select("path", "project"), "path").withColumn("file", F.col("path"))


_SRC = f", src AS (SELECT DISTINCT {sql_key('path')} AS path FROM source_files)"


@plan(_SRC + " SELECT fn_id, fn_name, kind, prog_lang, line_start, line_end, line_count, class_name FROM fn WHERE file IN (SELECT path FROM src)")
def source_graph(spark, root):
    """The functions of the current graph as read from source."""
    return _functions(_files(spark, root)).select("fn_id", "fn_name", "kind", "prog_lang", "line_start", "line_end", "line_count", "class_name")


@plan(None)
def source_functions(spark, root):
    f = _functions(_files(spark, root))
    return f.drop("file", "project").withColumn("params", F.to_json("params"))


@plan(_SRC + " SELECT DISTINCT path, text AS module FROM iraw WHERE capture = 'imp.module' AND path IN (SELECT path FROM src)")
def source_modules(spark, root):
    """Imported modules in dotted form."""
    return facts.imports(_files(spark, root)).where("capture = 'imp.module'").select("path", F.regexp_replace("text", "::", ".").alias("module")).distinct()


@plan(None)
def source_imports(spark, root):
    return facts.imports(_files(spark, root))


@plan(None)
def source_exports(spark, root):
    return facts.exports(_files(spark, root))


@plan(None)
def source_classes(spark, root):
    return facts.classes(_files(spark, root))


@plan(None)
def source_calls(spark, root):
    f = _files(spark, root)
    return G.enclosed_calls(facts.calls(f), _functions(f)).select("source_fn", "callee", "receiver", "line", "expression")


@plan(_SRC + " SELECT path, lines_of_code FROM fl WHERE path IN (SELECT path FROM src)")
def source_file_rows(spark, root):
    return facts.file_rows(_files(spark, root)).select("path", "lines_of_code")


@plan(None)
def source_call_edges(spark, root):
    """Call edges from source: sites, enclosing functions, names and self attributes resolved, confidence raised by imports."""
    f = _files(spark, root)
    fns = _functions(f)
    imports = facts.imports(f)
    edges = G.edges_from_calls(facts.calls(f), fns, imports, scan.init_attributes(f))
    files = f.select("path", "project").join(imports.groupBy("path").agg(F.collect_list(F.struct("capture", "text")).alias("imports")), "path", "left")
    up = G.upgrade_confidence(edges, G.resolve_imports(files, fns), files)
    return edges.drop("confidence", "project").join(up.select("source_fn", "target_fn", F.col("upgraded").alias("confidence")), ["source_fn", "target_fn"])


@plan(None)
def self_attr_resolution(spark, root):
    """Python methods of the graph and what their self attributes resolve to, read from source."""
    return G.attribute_targets(scan.init_attributes(_files(spark, root)), Graph(spark, root).functions("fn_name", "class_name"))


@plan(None)
def source_class_sizes(spark, root):
    f = _files(spark, root)
    return scan.class_sizes(f, facts.functions(f))


for _name, _f in {"source_collections": scan.value_collections, "source_class_attributes": scan.class_attributes, "source_literal_uses": scan.literal_use_kinds, "source_routes": scan.decorated_routes}.items():
    QUERIES[_name] = lambda spark, root, f=_f: f(_files(spark, root))
