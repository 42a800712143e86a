"""The engine's tables over the driver's files, and the same as SQL.

The graph tables hold five full snapshots with repeated deliveries; the current graph is the
newest snapshot that graph_files holds for each project, with the row loaded last per key (of
equal times the larger content). Every view takes the columns its query needs, so that a scan
reads no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.keys import blank_to_null, plain_key
from codeloom.operators.snapshots import delivery_calendar
from codeloom.runtime import table

#: Columns of the function and file views that are cleaned on the way.
_BLANK = {"return_type", "docstring", "route", "ast_hash", "intent"}
FUNCTION_COLUMNS = [
    "fn_name", "kind", "prog_lang", "line_start", "line_end", "params", "return_type", "is_async", "docstring", "complexity", "line_count", "route", "http_method", "template", "ast_hash", "intent", "secondary_intents", "class_name",
]
FILE_COLUMNS = ["prog_lang", "imports", "function_ids", "lines_of_code", "zone_name", "recent_commits", "source_hash"]


def latest(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(*keys, *cols) of the row of each key loaded last; of equal times the larger content, so that the result doesn't depend on row order."""
    if not cols:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct("loaded_at", *cols)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


class Graph:
    """The current graph of a folder as DataFrames, each read and cleaned where it is used."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def _newest(self) -> DataFrame:
        return self.table("graph_files").groupBy(F.trim("project").alias("project")).agg(F.max("snapshot_id").alias("snapshot_id"))

    def snapshot(self, name: str) -> DataFrame:
        """Rows of a graph table in their project's newest snapshot; the calendar, a row per project, is left to the size check of adaptive execution."""
        return self.table(name).withColumn("project", F.trim("project")).join(self._newest(), ["project", "snapshot_id"], "left_semi")

    def calendar(self) -> DataFrame:
        """(project, snapshot_id, prev_id, next_id) of the snapshots in which a project is delivered."""
        return delivery_calendar(self.table("graph_files"))

    def functions_of(self, rows: DataFrame, keys: tuple[str, ...] = (), cols: list[str] | None = None) -> DataFrame:
        """Cleaned function rows with the named columns (all without), the one loaded last per id (and further keys)."""
        want = FUNCTION_COLUMNS if cols is None else [c for c in cols if c != "project"]
        rest = [c for c in ["project", *want] if c not in keys]
        clean = [blank_to_null(F.col(c)).alias(c) if c in _BLANK else F.col(c) for c in rest]
        key = [*keys, "fn_id"]
        rows = rows.select(*keys, plain_key(F.col("id")).alias("fn_id"), *clean, "loaded_at").where("fn_id is not null")
        return latest(rows, key, rest).withColumn("file", F.split_part("fn_id", F.lit("::"), F.lit(1)))

    def functions(self, *cols: str) -> DataFrame:
        """(fn_id, project, file, *cols) of the current functions; all columns if none is named."""
        return self.functions_of(self.snapshot("graph_functions"), cols=list(cols) or None)

    def fn_ids(self) -> DataFrame:
        """(fn_id, project, file) of the current functions."""
        return self.functions_of(self.snapshot("graph_functions"), cols=[])

    def edges_of(self, rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """Call edges without repeats of (source, target, site, line, expression), within further keys."""
        e = rows.select(*keys, "project", plain_key(F.col("source_fn")).alias("source_fn"), plain_key(F.col("target_fn")).alias("target_fn"), plain_key(F.col("site_file")).alias("site_file"), "line", "expression", F.round("confidence", 2).alias("confidence"))
        return e.groupBy(*keys, "project", "source_fn", "target_fn", "site_file", "line", "expression").agg(F.max("confidence").alias("confidence"))

    def edges(self) -> DataFrame:
        return self.edges_of(self.snapshot("graph_call_edges"))

    def files(self, *cols: str) -> DataFrame:
        """(path, project, *cols) of the current files; all columns if none is named."""
        want = ["project", *[c for c in (cols or FILE_COLUMNS) if c != "project"]]
        rows = self.snapshot("graph_files").select(plain_key(F.col("path")).alias("path"), *want, "loaded_at").where("path is not null")
        return latest(rows, ["path"], want)

    def imports(self) -> DataFrame:
        """Import edges between files of one project: a module by its dotted path, a name by the first function of that name in another file."""
        from codeloom.operators.graph import resolve_imports

        return resolve_imports(self.files("imports"), self.functions("fn_name"))

    # Every delivered snapshot of every project, for differences over time.
    def functions_each(self, *cols: str) -> DataFrame:
        """(project, snapshot_id, fn_id, file, *cols) of all delivered snapshots."""
        rows = self.table("graph_functions").withColumn("project", F.trim("project")).withColumn("snapshot_id", F.col("snapshot_id").cast("int"))
        rows = rows.join(self.calendar().select("project", "snapshot_id"), ["project", "snapshot_id"], "left_semi")
        return self.functions_of(rows, ("project", "snapshot_id"), list(cols))

    def files_each(self, *cols: str) -> DataFrame:
        """(project, snapshot_id, path, *cols) of all delivered snapshots."""
        rows = self.table("graph_files").select(F.trim("project").alias("project"), F.col("snapshot_id").cast("int").alias("snapshot_id"), plain_key(F.col("path")).alias("path"), *cols, "loaded_at").where("path is not null and project is not null")
        return latest(rows, ["project", "snapshot_id", "path"], list(cols))

    def edges_each(self) -> DataFrame:
        rows = self.table("graph_call_edges").withColumn("project", F.trim("project")).withColumn("snapshot_id", F.col("snapshot_id").cast("int"))
        rows = rows.join(self.calendar().select("project", "snapshot_id"), ["project", "snapshot_id"], "left_semi")
        return self.edges_of(rows, ("snapshot_id",))


def sql_key(c: str) -> str:
    """plain_key in SQL."""
    return f"nullif(regexp_replace(regexp_replace(replace(trim({c}, E' \\t\\n\\r'), '\\', '/'), '/{{2,}}', '/', 'g'), '^(\\./)+', ''), '')"


def _blank(c: str) -> str:
    return f"nullif(trim({c}), '')"


FN_COLS = f"""{sql_key("g.id")} AS fn_id, g.project, g.fn_name, g.kind, g.prog_lang, g.line_start, g.line_end, g.params, {_blank("g.return_type")} AS return_type, g.is_async, {_blank("g.docstring")} AS docstring,
 g.complexity, g.line_count, {_blank("g.route")} AS route, g.http_method, g.template, {_blank("g.ast_hash")} AS ast_hash, {_blank("g.intent")} AS intent, g.secondary_intents, g.class_name"""

#: Common tables newest, fn, ed, fl, im of every oracle.
BASE = f"""WITH RECURSIVE newest AS (SELECT project, max(snapshot_id) AS snapshot_id FROM graph_files GROUP BY project),
fn AS (SELECT *, split_part(fn_id, '::', 1) AS file FROM (SELECT {FN_COLS}, row_number() OVER (PARTITION BY {sql_key("g.id")} ORDER BY g.loaded_at DESC) AS rn FROM graph_functions g JOIN newest USING (project, snapshot_id)) WHERE rn = 1),
ed AS (SELECT g.project, {sql_key("source_fn")} AS source_fn, {sql_key("target_fn")} AS target_fn, {sql_key("site_file")} AS site_file, line, expression, max(floor(confidence * 100 + 0.5) / 100) AS confidence FROM graph_call_edges g JOIN newest USING (project, snapshot_id) GROUP BY 1, 2, 3, 4, 5, 6),
fl AS (SELECT * FROM (SELECT {sql_key("g.path")} AS path, g.project, g.prog_lang, g.imports, g.function_ids, g.lines_of_code, g.zone_name, g.recent_commits, g.source_hash, row_number() OVER (PARTITION BY {sql_key("g.path")} ORDER BY g.loaded_at DESC) AS rn FROM graph_files g JOIN newest USING (project, snapshot_id)) WHERE rn = 1),
iraw AS (SELECT DISTINCT project, path, x.capture AS capture, x.text AS text FROM (SELECT project, path, unnest(imports) AS x FROM fl)),
stems AS (SELECT project, replace(regexp_replace(substr(path, length(project) + 2), '\\.[^.]*$', ''), '/', '.') AS dotted, max(path) AS target FROM fl GROUP BY 1, 2),
im AS (SELECT DISTINCT project, source_file, target_file FROM (
 SELECT i.project, i.path AS source_file, s.target AS target_file FROM iraw i JOIN stems s ON s.project = i.project AND s.dotted = i.text WHERE i.capture = 'imp.module'
 UNION ALL SELECT i.project, i.path, min(f.file) FROM iraw i JOIN fn f ON f.project = i.project AND f.fn_name = i.text AND f.file <> i.path WHERE i.capture = 'imp.name' GROUP BY i.project, i.path, i.text) WHERE target_file <> source_file)
"""

#: Common tables over every delivered snapshot: cal, fa (functions), pa (files), ea (edges), each with project and snapshot_id.
EACH = f"""WITH cal AS (SELECT project, snapshot_id, lag(snapshot_id) OVER (PARTITION BY project ORDER BY snapshot_id) AS prev_id FROM (SELECT DISTINCT project, snapshot_id FROM graph_files)),
fa AS (SELECT * FROM (SELECT g.snapshot_id, {FN_COLS}, split_part({sql_key("g.id")}, '::', 1) AS file, row_number() OVER (PARTITION BY g.project, g.snapshot_id, {sql_key("g.id")} ORDER BY g.loaded_at DESC) AS rn FROM graph_functions g JOIN cal USING (project, snapshot_id)) WHERE rn = 1),
pa AS (SELECT * FROM (SELECT project, snapshot_id, {sql_key("path")} AS path, source_hash, coalesce(function_ids, []) AS ids, lines_of_code, imports, row_number() OVER (PARTITION BY project, snapshot_id, {sql_key("path")} ORDER BY loaded_at DESC) AS rn FROM graph_files) WHERE rn = 1),
ea AS (SELECT DISTINCT g.project, g.snapshot_id, {sql_key("source_fn")} AS source_fn, {sql_key("target_fn")} AS target_fn, {sql_key("site_file")} AS site_file, line, expression FROM graph_call_edges g JOIN cal USING (project, snapshot_id))
"""


def sides(table: str) -> str:
    """SQL of (n, o): rows of a table of EACH in the later and, under the same snapshot_id, in the earlier snapshot of every transition."""
    return f""", n AS (SELECT t.* FROM {table} t JOIN cal USING (project, snapshot_id) WHERE prev_id IS NOT NULL),
o AS (SELECT t.* REPLACE (cal.snapshot_id AS snapshot_id) FROM {table} t JOIN cal ON cal.project = t.project AND cal.prev_id = t.snapshot_id) """
