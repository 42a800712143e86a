"""Graph queries over the current graph, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.plans.views import BASE, Graph, sql_key
from codeloom.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None):
    """Register a query under its function's name, with its SQL after the common tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, root: f(Graph(spark, root))
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return add


CALLERS = ", cd AS (SELECT target_fn AS fn_id, count(*) AS callers FROM ed GROUP BY 1), wc AS (SELECT fn.*, coalesce(cd.callers, 0) AS callers FROM fn LEFT JOIN cd USING (fn_id)) "
SPLIT = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '[_\-./]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '\s+'), lambda w: w <> '')"


@plan("SELECT (SELECT count(*) FROM fl) AS n_files, (SELECT count(*) FROM fn) AS n_functions, (SELECT string_agg(DISTINCT prog_lang, ',' ORDER BY prog_lang) FROM fn) AS languages, (SELECT count(*) FROM ed) AS n_edges")
def graph_totals(g):
    return G.graph_totals(g.functions("prog_lang"), g.edges(), g.files("project"))


@plan("SELECT target_fn AS fn_id, count(*) AS callers FROM ed GROUP BY 1")
def callers_degree(g):
    return G.callers_degree(g.edges())


@plan("SELECT source_fn AS fn_id, count(*) AS callees FROM ed GROUP BY 1")
def callees_degree(g):
    return G.callees_degree(g.edges())


@plan("SELECT fn_id, count(*) AS degree FROM (SELECT source_fn AS fn_id FROM ed UNION ALL SELECT target_fn FROM ed) GROUP BY 1")
def degree_centrality(g):
    return G.degree_centrality(g.edges())


@plan(CALLERS + "SELECT fn_id, file, fn_name, callers FROM wc WHERE callers > 0 ORDER BY callers DESC, fn_id LIMIT 5")
def hotspots_top5(g):
    return G.hotspots(g.functions("fn_name"), g.edges(), 1, 5)


@plan(CALLERS + "SELECT fn_id, file, fn_name, callers FROM wc WHERE callers >= 3")
def hotspots_min_callers(g):
    return G.hotspots(g.functions("fn_name"), g.edges(), 3)


@plan("SELECT fn_id, file, fn_name FROM fn WHERE fn_id IN (SELECT target_fn FROM ed)")
def locked_functions(g):
    return G.locked_functions(g.functions("fn_name"), g.edges())


@plan("SELECT fn_id, file FROM fn WHERE NOT EXISTS (SELECT 1 FROM ed WHERE target_fn = fn_id)")
def orphan_functions(g):
    return G.orphan_functions(g.fn_ids(), g.edges())


@plan("SELECT project, source_file, target_file FROM im")
def import_edges_named(g):
    return g.imports()


@plan(CALLERS + ", z AS (SELECT path AS file, coalesce(zone_name, 'unknown') AS zone FROM fl) SELECT zone, n_files, coalesce(n_functions, 0) AS n_functions, coalesce(n_routes, 0) AS n_routes, coalesce(n_locked, 0) AS n_locked FROM (SELECT zone, count(*) AS n_files FROM z GROUP BY 1) LEFT JOIN (SELECT zone, count(*) AS n_functions, count(route) AS n_routes, count(*) FILTER (callers > 0) AS n_locked FROM wc JOIN z USING (file) GROUP BY 1) USING (zone)")
def zone_map(g):
    return G.zone_map(g.functions("route"), g.edges(), g.files("zone_name"))


@plan(", z AS (SELECT path, coalesce(zone_name, 'unknown') AS zone FROM fl) SELECT a.zone AS from_zone, b.zone AS to_zone, count(*) AS n FROM im JOIN z a ON a.path = source_file JOIN z b ON b.path = target_file WHERE a.zone <> b.zone GROUP BY 1, 2")
def zone_imports(g):
    return G.zone_imports(g.imports(), g.files("zone_name"))


@plan("SELECT a.source_file AS file_a, a.target_file AS file_b FROM im a JOIN im b ON a.source_file = b.target_file AND a.target_file = b.source_file WHERE a.source_file < a.target_file")
def mutual_imports(g):
    return G.mutual_imports(g.imports())


@plan(""", calls AS (SELECT DISTINCT project, source_fn, split_part(source_fn, '::', 1) AS file, split_part(target_fn, '::', 2) AS callee FROM ed),
inames AS (SELECT DISTINCT path AS file, text AS callee FROM iraw WHERE capture = 'imp.name')
SELECT * FROM (SELECT c.source_fn, c.callee,
 coalesce((SELECT min(f.fn_id) FROM fn f JOIN inames i ON i.callee = f.fn_name WHERE i.file = c.file AND f.fn_name = c.callee AND f.project = c.project AND f.file <> c.file), (SELECT min(f.fn_id) FROM fn f WHERE f.file = c.file AND f.fn_name = c.callee), (SELECT CASE WHEN count(*) = 1 THEN min(f.fn_id) END FROM fn f WHERE f.project = c.project AND f.fn_name = c.callee)) AS target_fn,
 CASE WHEN (SELECT min(f.fn_id) FROM fn f JOIN inames i ON i.callee = f.fn_name WHERE i.file = c.file AND f.fn_name = c.callee AND f.project = c.project AND f.file <> c.file) IS NOT NULL THEN 1.0::double WHEN (SELECT min(f.fn_id) FROM fn f WHERE f.file = c.file AND f.fn_name = c.callee) IS NOT NULL THEN 0.95::double ELSE 0.5::double END AS confidence FROM calls c) WHERE target_fn IS NOT NULL""")
def call_resolution_cascade(g):
    return G.resolve_calls(G.named_calls(g.edges()), g.functions("fn_name"), G.imported_names(g.files("imports")))


@plan(""", e AS (SELECT source_fn, target_fn, split_part(source_fn, '::', 1) AS sf, split_part(target_fn, '::', 1) AS tf, split_part(target_fn, '::', 2) AS callee, max(confidence) AS confidence FROM ed GROUP BY 1, 2)
SELECT source_fn, target_fn, confidence, CASE WHEN confidence < 0.9 AND EXISTS (SELECT 1 FROM im WHERE source_file = sf AND target_file = tf) THEN CASE WHEN EXISTS (SELECT 1 FROM iraw WHERE path = sf AND capture = 'imp.name' AND text = callee) THEN 0.95 ELSE greatest(confidence, 0.85) END ELSE confidence END AS upgraded FROM e""")
def confidence_upgrade(g):
    return G.upgrade_confidence(g.edges(), g.imports(), g.files("imports"))


@plan("SELECT s.site_file, s.line, fn.fn_id FROM (SELECT DISTINCT site_file, line FROM ed) s JOIN fn ON fn.file = s.site_file AND s.line BETWEEN fn.line_start AND fn.line_end")
def call_site_enclosing(g):
    return G.enclosing_functions(g.edges(), g.functions("line_start", "line_end"))


TOP = CALLERS + ", top AS (SELECT fn_id FROM wc WHERE callers > 0 ORDER BY callers DESC, fn_id LIMIT 5) "


@plan(TOP + "SELECT DISTINCT top.fn_id AS centre, 'up' AS side, source_fn AS fn_id FROM ed JOIN top ON target_fn = top.fn_id UNION SELECT DISTINCT top.fn_id, 'down', target_fn FROM ed JOIN top ON source_fn = top.fn_id")
def neighbourhood_1hop(g):
    return G.neighbourhood(g.edges(), G.hotspots(g.functions("fn_name"), g.edges(), 1, 5))


@plan(""", roots AS (SELECT project, coalesce(min(path) FILTER (string_split(path, '/')[-1] IN ('app.py', 'main.py', 'manage.py', 'wsgi.py', 'asgi.py', '__main__.py', 'server.py', 'run.py')), min(path)) AS root FROM fl GROUP BY 1),
walk AS (SELECT root, root AS path, 0 AS depth FROM roots UNION ALL SELECT w.root, i.target_file, w.depth + 1 FROM walk w JOIN im i ON i.source_file = w.path WHERE w.depth < 2)
SELECT root, path, min(depth)::int AS depth FROM walk GROUP BY 1, 2""")
def startup_chain_bfs(g):
    return G.bounded_bfs(g.imports(), G.entry_points(g.files("project")), 2)


DEBT = """, debt AS (SELECT 'complexity' AS category, CASE WHEN complexity >= 15 THEN 'high' WHEN complexity >= 10 THEN 'medium' END AS severity, fn_id AS target, complexity::bigint AS value FROM fn
UNION ALL SELECT 'long_function', CASE WHEN line_count >= 100 THEN 'high' WHEN line_count >= 50 THEN 'medium' END, fn_id, line_count FROM fn
UNION ALL SELECT 'monster_file', CASE WHEN coalesce(len(function_ids), 0) >= 30 THEN 'high' WHEN coalesce(len(function_ids), 0) >= 15 THEN 'medium' END, path, coalesce(len(function_ids), 0) FROM fl
UNION ALL SELECT 'circular_import', 'medium', a.source_file || ' <-> ' || a.target_file, 0 FROM im a JOIN im b ON a.source_file = b.target_file AND a.target_file = b.source_file WHERE a.source_file < a.target_file) """


@plan(DEBT + "SELECT category, severity, target, value FROM debt WHERE severity IS NOT NULL")
def debt_items(g):
    return G.debt_items(g.functions("complexity", "line_count"), g.files("function_ids"), g.imports())


@plan(DEBT + "SELECT total, high, medium, high * 3 + medium AS score, floor((high * 3 + medium) * 100.0::double / greatest((SELECT count(*) FROM fn), 1) * 10 + 0.5) / 10 AS density FROM (SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM debt WHERE severity IS NOT NULL)")
def debt_summary(g):
    f = g.functions("complexity", "line_count")
    return G.debt_summary(G.debt_items(f, g.files("function_ids"), g.imports()), f)


@plan(""", e AS (SELECT target_fn, split_part(target_fn, '::', 1) AS file, split_part(source_fn, '::', 1) AS src FROM ed)
SELECT file, coalesce(importers, 0) AS importers, coalesce(migration_cost, 0) AS migration_cost, coalesce(locked_fns, 0) AS locked_fns, coalesce(prod_locked, 0) AS prod_locked FROM (SELECT DISTINCT file FROM fn)
LEFT JOIN (SELECT target_file AS file, count(DISTINCT source_file) AS importers FROM im GROUP BY 1) USING (file)
LEFT JOIN (SELECT file, count(*) FILTER (src <> file) AS migration_cost, count(DISTINCT target_fn) AS locked_fns, count(DISTINCT target_fn) FILTER (NOT regexp_matches(lower(src), 'tests?/|test_|conftest\\.py')) AS prod_locked FROM e GROUP BY 1) USING (file)""")
def files_block(g):
    return G.files_block(g.fn_ids(), g.edges(), g.imports())


@plan("SELECT target_fn AS fn_id, count(*) AS callers, count(DISTINCT split_part(source_fn, '::', 1)) AS caller_files, count(*) FILTER (regexp_matches(lower(split_part(source_fn, '::', 1)), 'tests?/|test_|conftest\\.py')) AS test_callers FROM ed GROUP BY 1")
def functions_block(g):
    return G.functions_block(g.edges())


@plan(CALLERS + "SELECT fn_id, fn_name, callers FROM wc JOIN fl ON fl.path = wc.file WHERE zone_name = 'core' ORDER BY fn_id LIMIT 20 OFFSET 10")
def browse_page(g):
    return G.page(g.functions("fn_name"), g.edges(), "core", g.files("zone_name"), 10, 20)


@plan(""", num AS (SELECT project, fn_id, row_number() OVER (PARTITION BY project ORDER BY fn_id)::int AS pos FROM fn),
who AS (SELECT t.project, e.target_fn AS fn_id, (t.pos // 1000)::int AS block, string_agg(t.pos::varchar, ',' ORDER BY t.pos) AS callers FROM (SELECT DISTINCT source_fn, target_fn FROM ed) e JOIN num t ON t.fn_id = e.source_fn GROUP BY 1, 2, 3)
SELECT num.project, pos, num.fn_id, coalesce(block, 0) AS block, coalesce(callers, '') AS callers FROM num LEFT JOIN who ON who.fn_id = num.fn_id AND who.project = num.project""")
def functions_graph_index(g):
    return G.graph_index(g.fn_ids(), g.edges())


@plan(", c AS (SELECT source_fn AS fn_id, array_to_string(list_sort(list(target_fn))[1:8], ',') AS callees FROM (SELECT DISTINCT source_fn, target_fn FROM ed) GROUP BY 1) SELECT file, route, http_method, fn_id, coalesce(callees, '') AS callees FROM fn LEFT JOIN c USING (fn_id) WHERE route IS NOT NULL")
def routes_listing(g):
    return G.routes(g.functions("route", "http_method"), g.edges())


@plan(""", deg AS (SELECT fn_id, count(*) AS degree FROM (SELECT source_fn AS fn_id FROM ed UNION ALL SELECT target_fn FROM ed) GROUP BY 1), r AS (SELECT project, fn_id, fn_name, route, coalesce(degree, 0) AS degree FROM fn LEFT JOIN deg USING (fn_id)),
r1 AS (SELECT project, fn_id, degree, 0 AS tier FROM r WHERE route IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY degree DESC, fn_id) <= 3),
r2 AS (SELECT project, fn_id, degree, 1 AS tier FROM r WHERE left(fn_name, 1) <> '_' AND degree > 0 AND fn_id NOT IN (SELECT fn_id FROM r1))
SELECT project, n::int AS n, fn_id, degree FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY tier, degree DESC, fn_id) AS n FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2)) WHERE n <= 12""")
def data_flow_targets(g):
    return G.data_flow_targets(g.functions("fn_name", "route"), g.edges())


@plan(""", tags AS (SELECT DISTINCT fn_id, unnest(secondary_intents) AS tag FROM fn), n AS (SELECT tag, count(*) - 1 AS others FROM tags GROUP BY 1 HAVING count(*) > 1)
SELECT fn_id, sum(others)::bigint AS n_similar, string_agg(tag, '|' ORDER BY tag) AS tags FROM tags JOIN n USING (tag) GROUP BY 1""")
def similar_logic(g):
    return G.similar_logic(g.functions("secondary_intents"))


@plan("SELECT fn_id, min(fn_id) OVER w AS clone_class, count(*) OVER w - 1 AS n_links FROM fn WHERE ast_hash IS NOT NULL WINDOW w AS (PARTITION BY ast_hash) QUALIFY n_links > 0")
def exact_clones(g):
    return G.exact_clones(g.functions("ast_hash"))


@plan(", s AS (SELECT DISTINCT list_sort(list_distinct(" + SPLIT.format(c="fn_name") + ")) AS ws FROM fn) SELECT array_to_string(a.ws, ' ') AS name_a, array_to_string(b.ws, ' ') AS name_b, floor(len(list_intersect(a.ws, b.ws))::double / len(list_distinct(list_concat(a.ws, b.ws))) * 10000 + 0.5) / 10000 AS jaccard FROM s a JOIN s b ON array_to_string(a.ws, ' ') < array_to_string(b.ws, ' ') WHERE len(list_intersect(a.ws, b.ws))::double / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.7 - 1e-12")
def near_clones(g):
    return G.near_clone_names(g.functions("fn_name"))


@plan(", w AS (SELECT project, (" + SPLIT.format(c="fn_name") + ")[1] AS word FROM fn), n AS (SELECT project, word, count(*) AS n FROM w WHERE word IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2) SELECT project, word, n FROM n QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, word) <= 5")
def name_prefix_patterns(g):
    return G.name_prefixes(g.functions("fn_name"))


@plan("SELECT fn_id, array_to_string(" + SPLIT.format(c="fn_name") + ", ' ') AS words FROM fn")
def split_identifier_tokens(g):
    return g.functions("fn_name").select("fn_id", F.array_join(G.T.split_identifier(F.col("fn_name")), " ").alias("words"))


@plan(CALLERS + "SELECT project, fn_id, callers FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY callers, fn_id) AS r, count(*) OVER (PARTITION BY project) AS n FROM wc) WHERE r = n // 2 + 1")
def median_scope_fn(g):
    return G.median_function(g.fn_ids(), g.edges())


@plan(f", r AS (SELECT {sql_key('i.fn_id')} AS fn_id, risk_level, risk_score FROM impact_reports i QUALIFY row_number() OVER (PARTITION BY {sql_key('i.fn_id')} ORDER BY generated_at DESC) = 1) SELECT fn.fn_id, risk_level, risk_score FROM fn LEFT JOIN r USING (fn_id)")
def impact_risk(g):
    from codeloom.functions.keys import plain_key

    return G.risk_view(g.fn_ids(), table(g.spark, g.root, "impact_reports").withColumn("fn_id", plain_key(F.col("fn_id"))))


@plan("SELECT fn_id, '(' || coalesce(array_to_string(list_transform(params, lambda p: p.name || CASE WHEN coalesce(p.type_hint, '') <> '' THEN ': ' || p.type_hint ELSE '' END), ', '), '') || ')' || CASE WHEN return_type IS NOT NULL THEN ' -> ' || return_type ELSE '' END AS signature FROM fn")
def signatures(g):
    return g.functions("params", "return_type").select("fn_id", G.T.signature(F.col("params"), F.col("return_type")).alias("signature"))


@plan("SELECT path, CASE WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[2] ELSE regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') END AS zone FROM fl")
def path_zone(g):
    return g.files("project").select("path", G.T.zone_of_path(F.col("path")).alias("zone"))


@plan("SELECT source_fn, target_fn, site_file, line, expression, confidence FROM ed")
def edge_dedup(g):
    return g.edges().drop("project")


@plan("SELECT source_fn, target_fn, count(*) AS sites, max(confidence) AS confidence FROM ed GROUP BY 1, 2")
def edge_pairs(g):
    return g.edges().groupBy("source_fn", "target_fn").agg(F.count(F.lit(1)).alias("sites"), F.max("confidence").alias("confidence"))


@plan("SELECT path, c.sha AS sha, c.author AS author, c.commit_date AS commit_date FROM (SELECT path, unnest(recent_commits) AS c FROM fl) QUALIFY row_number() OVER (PARTITION BY path ORDER BY c.commit_date DESC, c.sha) <= 5")
def recent_commits_top5(g):
    from pyspark.sql import Window as W

    c = g.files("recent_commits").select("path", F.explode("recent_commits").alias("c")).select("path", "c.sha", "c.author", "c.commit_date")
    return c.withColumn("n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("commit_date"), "sha"))).where("n <= 5").drop("n")
