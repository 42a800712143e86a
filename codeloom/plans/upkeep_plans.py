"""Update, audit, rule and budget queries, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import upkeep as U
from codeloom.operators.snapshots import transitions
from codeloom.plans.graph_plans import TOP
from codeloom.plans.more_plans import _SESS, STEP, _entries, _units
from codeloom.plans.views import BASE, EACH, Graph, sides

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None, base: str = BASE):
    def add(f):
        QUERIES[f.__name__] = lambda spark, root: f(Graph(spark, root))
        if sql:
            ORACLES[f.__name__] = base + sql
        return f

    return add


# Differences between each delivered snapshot of a project and its previous one; snapshot_id is the later.
_CH = sides("pa") + ", ch AS (SELECT project, snapshot_id, path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.source_hash = n.source_hash THEN 'same' ELSE 'changed' END AS status FROM o FULL JOIN n USING (project, snapshot_id, path)) "


def _changed(g):
    return U.changed_files(*transitions(g.files_each("source_hash"), g.calendar()), *STEP)


@plan(_CH + "SELECT project, snapshot_id, path, status FROM ch", EACH)
def changed_files(g):
    return _changed(g)


_FSIDES = sides("fa").replace(" n AS", " fnew AS").replace("o AS (", "fold AS (")


@plan(_CH + _FSIDES + """, t AS (SELECT project, snapshot_id, path AS file FROM ch WHERE status <> 'same')
SELECT project, snapshot_id, fn_id, file, ast_hash FROM fold ANTI JOIN t USING (project, snapshot_id, file) UNION ALL SELECT project, snapshot_id, fn_id, file, ast_hash FROM fnew SEMI JOIN t USING (project, snapshot_id, file)""", EACH)
def incremental_update(g):
    stored, fresh = (d.select(*STEP, "fn_id", "file", "ast_hash") for d in transitions(g.functions_each("ast_hash"), g.calendar()))
    return U.update_rows(stored, fresh, _changed(g), keys=STEP)


_ESIDES = sides("ea")


@plan(_ESIDES + sides("fa").replace(" n AS", " fnew AS").replace("o AS (", "fold AS (") + """, fresh AS (SELECT DISTINCT project, snapshot_id, site_file, line FROM (SELECT n.project, n.snapshot_id, n.source_fn, n.target_fn, n.site_file, n.expression, n.line FROM n) ANTI JOIN o USING (project, snapshot_id, source_fn, target_fn, site_file, expression))
SELECT project, snapshot_id, fn_id, file FROM fnew f WHERE EXISTS (SELECT 1 FROM fresh h WHERE h.project = f.project AND h.snapshot_id = f.snapshot_id AND h.site_file = f.file AND h.line BETWEEN f.line_start AND f.line_end)""", EACH)
def modified_functions(g):
    """Functions whose span holds a line with a call that the previous snapshot doesn't know."""
    old, new = transitions(g.edges_each(), g.calendar())
    same = [*STEP, "source_fn", "target_fn", "site_file", "expression"]
    key = lambda d: d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias("k" + str(i)) for i, c in enumerate(same)], *d.columns)
    ks = [f"k{i}" for i in range(len(same))]
    lines = key(new).join(key(old).select(*ks), ks, "left_anti").select(*STEP, F.col("site_file").alias("file"), "line").distinct()
    f = transitions(g.functions_each("line_start", "line_end"), g.calendar())[1]
    return U.overlapping_functions(f, lines, *STEP)


@plan(_CH + """, p AS (SELECT DISTINCT snapshot_id, path, substr(path, instr(path, '/') + 1) AS w FROM ch WHERE status = 'changed'), u AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY trim(id) ORDER BY updated_at DESC, source_hash DESC) = 1),
f AS (SELECT DISTINCT p.snapshot_id, trim(id) AS id, kind, 'file' AS reason FROM (SELECT id, kind, unnest(source_files) AS s FROM u) x JOIN p ON p.path = x.s),
x AS (SELECT DISTINCT p.snapshot_id, trim(id) AS id, kind, 'text' AS reason FROM (SELECT id, kind, unnest(regexp_extract_all(description, '[\\w-]+(?:/[\\w.-]+)+')) AS w FROM u) y JOIN p USING (w)),
b AS (SELECT * FROM f UNION ALL SELECT * FROM x ANTI JOIN f USING (snapshot_id, id))
SELECT snapshot_id, id, kind, reason FROM b QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY CASE WHEN kind = 'function_unit' THEN 0 ELSE 1 END, CASE WHEN reason = 'file' THEN 0 ELSE 1 END, id) <= 30""", EACH)
def audit_packet(g):
    return U.audit_units(_units(g), _changed(g).where("status = 'changed'"), keys=("snapshot_id",))


@plan("SELECT target_file AS path, count(DISTINCT source_file) AS importers FROM im GROUP BY 1 HAVING count(DISTINCT source_file) >= 1")
def popular_files(g):
    return U.popular_files(g.imports(), 1)


@plan(TOP + ", near AS (SELECT source_fn AS fn_id FROM ed WHERE target_fn IN (SELECT fn_id FROM top) UNION SELECT target_fn FROM ed WHERE source_fn IN (SELECT fn_id FROM top) UNION SELECT fn_id FROM top) SELECT DISTINCT split_part(fn_id, '::', 1) AS file FROM near")
def preview_highlight(g):
    top = G.hotspots(g.functions("fn_name"), g.edges(), 1, 5).select("fn_id")
    near = G.neighbourhood(g.edges(), top).select("fn_id").unionByName(top)
    return near.select(G.file_of("fn_id").alias("file")).distinct()


@plan(_SESS + ", s AS (SELECT session_id, min(t) AS st, min_by(sha256(json_extract_string(message, '$.content')), t) FILTER (kind = 'user' AND json_type(message, '$.content') = 'VARCHAR' AND t IS NOT NULL) AS task_hash FROM e GROUP BY 1) SELECT session_id, redo_of FROM (SELECT session_id, lag(session_id) OVER (PARTITION BY task_hash ORDER BY st, session_id) AS redo_of FROM s WHERE task_hash IS NOT NULL) WHERE redo_of IS NOT NULL", "")
def redo_detection(g):
    e = _entries(g)
    text = (F.col("kind") == "user") & (F.schema_of_variant(F.try_variant_get(F.try_parse_json("message"), "$.content", "variant")) == "STRING") & F.col("t").isNotNull()
    s = e.groupBy("session_id").agg(F.min("t").alias("started_at"), F.min_by(F.sha2("content", 256), F.when(text, F.col("t"))).alias("task_hash"))
    return U.redone_tasks(s)


@plan(""", s AS (SELECT project, file, sum(line_count)::bigint AS tokens, row_number() OVER (PARTITION BY project ORDER BY file) AS i FROM fn GROUP BY 1, 2),
g AS (SELECT project, i, CASE WHEN tokens <= 300 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 300 THEN [file] ELSE [] END AS names FROM s WHERE i = 1 UNION ALL SELECT s.project, s.i, CASE WHEN g.used + tokens <= 300 THEN g.used + tokens ELSE g.used END, CASE WHEN g.used + tokens <= 300 THEN list_append(g.names, file) ELSE g.names END FROM g JOIN s ON s.project = g.project AND s.i = g.i + 1)
SELECT project, array_to_string(max_by(names, i), '|') AS taken FROM g GROUP BY 1""")
def budget_sections(g):
    # sections are files with their lines, tried in order of name
    s = g.functions("line_count").groupBy("project", "file").agg(F.sum("line_count").alias("tokens")).groupBy("project").agg(F.array_sort(F.collect_list(F.struct(F.col("file").alias("name"), F.col("tokens").cast("long").alias("tokens")))).alias("sections"))
    return s.select("project", F.array_join(U.greedy_budget(F.col("sections"), 300), "|").alias("taken"))
