"""Target resolution and the composed answers over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.keys import plain_key
from codeloom.operators import graph as G
from codeloom.operators import search as S
from codeloom.operators import targets as R
from codeloom.operators import tools
from codeloom.plans import graph_plans, more_plans
from codeloom.plans.graph_plans import CALLERS
from codeloom.plans.more_plans import STEP, _units
from codeloom.plans.views import BASE, EACH, Graph, latest, sql_key

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None, base: str = BASE):
    def add(f):
        QUERIES[f.__name__] = lambda spark, root: f(Graph(spark, root))
        if sql:
            ORACLES[f.__name__] = base + sql
        return f

    return add


def _docs(g):
    return g.table("documents").select("doc_id", F.trim("project").alias("project"), "text").where("doc_id is not null")


_BARE = "regexp_replace(m, '\\s*\\($', '')"
_STOP = ", ".join(f"'{w}'" for w in R.NO_FUNCTIONS)
# words don't begin behind a letter that RE2 takes for none
_GLUED = "regexp_replace(regexp_replace(coalesce(text, ''), '" + R.DOUBLE_COLON + "', ' ', 'g'), '([\\x{00AA}-\\x{024F}\\x{0370}-\\x{1FFF}\\x{3040}-\\x{9FFF}])[A-Za-z0-9_]+', '\\1', 'g')"
_DOCS = f"""docs AS (SELECT doc_id, trim(project) AS project, coalesce(text, '') AS text, {_GLUED} AS rest FROM documents WHERE doc_id IS NOT NULL),
wn AS (SELECT DISTINCT doc_id, project, unnest(list_concat(list_transform(regexp_extract_all(text, '{R.DOUBLE_COLON}'), lambda m: split_part(m, '::', 2)), list_transform(regexp_extract_all(rest, '{R.CLASS_METHOD}'), lambda m: {_BARE}),
 list_filter(regexp_extract_all(rest, '{R.CLASS_ATTRIBUTE}'), lambda m: m[-1] <> '('), list_filter(list_transform(regexp_extract_all(rest, '{R.CALL}'), lambda m: {_BARE}), lambda m: length(m) >= {R.LEAST_CALL} AND lower(m) NOT IN ({_STOP})))) AS raw FROM docs),
wp AS (SELECT DISTINCT doc_id, project, unnest(list_transform(regexp_extract_all(text, '{R.PATH}'), lambda m: replace(m, '\\', '/'))) AS raw FROM docs)"""


@plan(f"WITH {_DOCS} SELECT DISTINCT doc_id, 'name' AS kind, raw AS target FROM wn UNION ALL SELECT DISTINCT doc_id, 'path', raw FROM wp", "")
def explicit_targets(g):
    return R.explicit_targets(_docs(g)).distinct()


_MARKED = " OR ".join(f"contains(lower(text), '{m}')" for m in R.TEST_MARKERS)
_TEST = "regexp_matches(lower({c}), 'tests?/|test_|conftest\\.py')"
_RESOLVED = f""", {_DOCS},
rel AS (SELECT project, path, zone_name, CASE WHEN starts_with(path, project || '/') THEN substr(path, length(project) + 2) ELSE path END AS rel FROM fl),
p1 AS (SELECT wp.*, rel.path FROM wp JOIN rel ON rel.project = wp.project AND rel.rel = wp.raw),
p2 AS (SELECT w.doc_id, w.project, w.raw, min(rel.path) AS path FROM (SELECT * FROM wp ANTI JOIN p1 USING (doc_id, project, raw)) w JOIN rel ON rel.project = w.project AND lower(rel.rel) = lower(w.raw) GROUP BY 1, 2, 3),
p3 AS (SELECT w.*, rel.path FROM (SELECT * FROM wp ANTI JOIN p1 USING (doc_id, project, raw) ANTI JOIN p2 USING (doc_id, project, raw)) w JOIN rel ON rel.project = w.project AND lower(string_split(rel.rel, '/')[-1]) = lower(w.raw) WHERE NOT contains(w.raw, '/')),
nf AS (SELECT wn.doc_id, fn.fn_id, fn.file FROM wn JOIN fn ON fn.project = wn.project AND ((NOT contains(wn.raw, '.') AND fn.fn_name = wn.raw) OR (contains(wn.raw, '.') AND fn.class_name || '.' || fn.fn_name = wn.raw))),
ex AS (SELECT doc_id, 'path' AS kind, path AS target FROM p1 UNION SELECT doc_id, 'path', path FROM p2 UNION SELECT doc_id, 'path', path FROM p3 UNION SELECT doc_id, 'function', fn_id FROM nf UNION SELECT doc_id, 'path', file FROM nf),
words AS (SELECT DISTINCT doc_id, project, w FROM (SELECT doc_id, project, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM docs) WHERE length(w) >= {R.LEAST_NAME}),
runs AS (SELECT doc_id, project, string_split(r, '/') AS parts FROM (SELECT doc_id, project, regexp_replace(unnest(regexp_extract_all(lower(text), '[a-z0-9_./-]+')), '^[./-]+|[./-]+$', '', 'g') AS r FROM docs) WHERE contains(r, '.')),
tails AS (SELECT DISTINCT doc_id, project, w FROM (SELECT doc_id, project, array_to_string(parts[i:], '/') AS w FROM (SELECT doc_id, project, parts, unnest(range(1, len(parts) + 1)) AS i FROM runs)) WHERE length(w) >= {R.LEAST_NAME}),
fz AS (SELECT doc_id, 'zone' AS kind, zone_name AS target FROM words JOIN (SELECT DISTINCT project, zone_name FROM fl) z ON z.project = words.project AND lower(zone_name) = w
 UNION SELECT doc_id, 'path', path FROM tails JOIN rel ON rel.project = tails.project AND (lower(rel.rel) = w OR lower(string_split(rel.rel, '/')[-1]) = w)
 UNION SELECT doc_id, 'function', fn_id FROM words JOIN fn ON fn.project = words.project AND lower(fn.fn_name) = w),
bo AS (SELECT doc_id, kind, target, min(r) AS r FROM (SELECT *, 0 AS r FROM ex UNION ALL SELECT *, 1 FROM fz) GROUP BY 1, 2, 3),
oz AS (SELECT DISTINCT b.doc_id, 'path' AS kind, fl.path AS target, 1 AS r FROM bo b JOIN docs USING (doc_id) JOIN fl ON fl.project = docs.project AND fl.zone_name = b.target WHERE b.kind = 'zone' AND b.doc_id NOT IN (SELECT doc_id FROM bo WHERE kind = 'path')),
te AS (SELECT doc_id FROM docs WHERE {_MARKED} UNION SELECT doc_id FROM wp WHERE {_TEST.format(c='raw')} UNION SELECT doc_id FROM bo WHERE kind = 'zone' AND contains(lower(target), 'test')),
res AS (SELECT doc_id, kind, target, CASE WHEN min(r) = 0 THEN 'explicit' ELSE 'fuzzy' END AS how FROM (SELECT * FROM bo UNION ALL SELECT * FROM oz) WHERE doc_id IN (SELECT doc_id FROM te) OR kind = 'zone' OR NOT {_TEST.format(c="split_part(target, '::', 1)")} GROUP BY 1, 2, 3) """


def _resolved(g):
    return R.resolve_targets(_docs(g), g.files("zone_name"), g.functions("fn_name", "class_name"))


@plan(_RESOLVED + "SELECT doc_id, kind, target, how FROM res")
def resolved_targets(g):
    return _resolved(g)


_FACTS = """, ff AS (SELECT file, coalesce(importers, 0) AS importers, coalesce(migration_cost, 0) AS migration_cost, coalesce(locked_fns, 0) AS locked_fns FROM (SELECT DISTINCT file FROM fn)
 LEFT JOIN (SELECT target_file AS file, count(DISTINCT source_file) AS importers FROM im GROUP BY 1) USING (file) LEFT JOIN (SELECT split_part(target_fn, '::', 1) AS file, count(*) FILTER (split_part(source_fn, '::', 1) <> split_part(target_fn, '::', 1)) AS migration_cost, count(DISTINCT target_fn) AS locked_fns FROM ed GROUP BY 1) USING (file)),
fb AS (SELECT target_fn AS fn_id, count(*) AS callers, count(DISTINCT split_part(source_fn, '::', 1)) AS caller_files, count(*) FILTER (regexp_matches(lower(split_part(source_fn, '::', 1)), 'tests?/|test_|conftest\\.py')) AS test_callers FROM ed GROUP BY 1) """
_WORDS = more_plans._stems("regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')")
_WORDS2 = more_plans._stems("regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9]*')")


@plan(_RESOLVED + _FACTS + f""", hd AS (SELECT DISTINCT doc_id, CASE WHEN list_has_any({_WORDS}, {more_plans._stems(str(S.CHANGE))}) THEN 'change' WHEN list_has_any({_WORDS}, {more_plans._stems(str(S.CREATE))}) THEN 'create' ELSE 'unknown' END AS category, list_has_any({_WORDS2}, {more_plans._stems(str(R.REMOVALS))}) AS shrinks FROM documents)
SELECT doc_id, category, shrinks, kind, target, how, coalesce(importers, 0) AS importers, coalesce(migration_cost, 0) AS migration_cost, coalesce(locked_fns, 0) AS locked_fns, coalesce(callers, 0) AS callers, coalesce(caller_files, 0) AS caller_files, coalesce(test_callers, 0) AS test_callers
FROM res JOIN hd USING (doc_id) LEFT JOIN ff ON kind = 'path' AND ff.file = target LEFT JOIN fb ON kind = 'function' AND fb.fn_id = target""")
def before_create(g):
    docs = _docs(g)
    return tools.before_create(_resolved(g), docs, G.files_block(g.fn_ids(), g.edges(), g.imports()), G.functions_block(g.edges()), S.intent_category)


_LOCKED = CALLERS + ", z AS (SELECT path AS file, coalesce(zone_name, 'unknown') AS zone FROM fl) SELECT zone, n, fn_id, callers FROM (SELECT zone, fn_id, callers, row_number() OVER (PARTITION BY zone ORDER BY callers DESC, fn_id)::int AS n FROM wc JOIN z USING (file) WHERE callers > 0) WHERE n <= 5"


@plan(_LOCKED)
def locked_by_zone(g):
    """The five functions of each zone with the most callers."""
    z = g.files("zone_name").select(F.col("path").alias("file"), F.coalesce("zone_name", F.lit("unknown")).alias("zone"))
    rows = G.with_callers(g.fn_ids(), g.edges()).where("callers > 0").join(z, "file")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("zone").orderBy(F.desc("callers"), "fn_id"))).where("n <= 5").select("zone", "n", "fn_id", "callers")


@plan(f""", cd AS (SELECT target_fn AS fn_id, count(*) AS callers FROM ed GROUP BY 1), ce AS (SELECT source_fn AS fn_id, count(*) AS callees FROM ed GROUP BY 1), z AS (SELECT path AS file, coalesce(zone_name, 'unknown') AS zone FROM fl),
sib AS (SELECT target_file AS file, count(DISTINCT source_file) AS siblings FROM im JOIN z a ON a.file = source_file JOIN z b ON b.file = target_file WHERE a.zone = b.zone GROUP BY 1),
roots AS (SELECT project, coalesce(min(path) FILTER (string_split(path, '/')[-1] IN ('app.py', 'main.py', 'manage.py', 'wsgi.py', 'asgi.py', '__main__.py', 'server.py', 'run.py')), min(path)) AS root FROM fl GROUP BY 1),
walk AS (SELECT root AS path, 0 AS depth FROM roots UNION ALL SELECT i.target_file, w.depth + 1 FROM walk w JOIN im i ON i.source_file = w.path WHERE w.depth < 2), st AS (SELECT DISTINCT path AS file, true AS in_startup FROM walk),
tags AS (SELECT DISTINCT fn_id, unnest(secondary_intents) AS tag FROM fn), tn AS (SELECT tag, count(*) - 1 AS others FROM tags GROUP BY 1 HAVING count(*) > 1), sm AS (SELECT fn_id, sum(others)::bigint AS n_similar FROM tags JOIN tn USING (tag) GROUP BY 1),
rk AS (SELECT {sql_key('i.fn_id')} AS fn_id, risk_level FROM impact_reports i QUALIFY row_number() OVER (PARTITION BY {sql_key('i.fn_id')} ORDER BY generated_at DESC) = 1)
SELECT fn.fn_id, '(' || coalesce(array_to_string(list_transform(params, lambda p: p.name || CASE WHEN coalesce(p.type_hint, '') <> '' THEN ': ' || p.type_hint ELSE '' END), ', '), '') || ')' || CASE WHEN return_type IS NOT NULL THEN ' -> ' || return_type ELSE '' END AS signature,
 CASE WHEN route IS NOT NULL THEN '[' || coalesce(http_method, 'GET') || ' ' || route || ']' ELSE '' END AS marker, coalesce(zone, 'unknown') AS zone, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(siblings, 0) AS siblings, coalesce(in_startup, false) AS in_startup, coalesce(n_similar, 0) AS n_similar, risk_level
FROM fn LEFT JOIN z USING (file) LEFT JOIN sib USING (file) LEFT JOIN st USING (file) LEFT JOIN cd USING (fn_id) LEFT JOIN ce USING (fn_id) LEFT JOIN sm USING (fn_id) LEFT JOIN rk USING (fn_id)""")
def scope(g):
    reports = g.table("impact_reports").withColumn("fn_id", plain_key(F.col("fn_id")))
    return tools.scope(g.functions("params", "return_type", "route", "http_method", "secondary_intents"), g.edges(), g.files("zone_name"), g.imports(), reports)


_VALUES = ", ".join(["vn AS (SELECT t.* FROM pa t JOIN cal USING (project, snapshot_id) WHERE prev_id IS NOT NULL)", "vo AS (SELECT t.* REPLACE (cal.snapshot_id AS snapshot_id) FROM pa t JOIN cal ON cal.project = t.project AND cal.prev_id = t.snapshot_id)"])


@plan(f"""{more_plans.ORACLES["signature_diff"].removeprefix(EACH).rsplit("SELECT project, snapshot_id, fn_id, CASE", 1)[0]}, sd AS (SELECT project, snapshot_id, fn_id, CASE{more_plans.ORACLES["signature_diff"].rsplit("SELECT project, snapshot_id, fn_id, CASE", 1)[1]}), {_VALUES},
vd AS (SELECT project, snapshot_id, path, array_to_string(list_sort(list_distinct(list_filter(vo.ids, lambda x: NOT list_contains(vn.ids, x)))), '|') AS removed FROM vo JOIN vn USING (project, snapshot_id, path))
SELECT project, snapshot_id, 'broken_caller' AS warning, 'error' AS severity, fn_id AS target, change AS detail FROM sd WHERE callers > 0 AND (change = 'removed' OR note = 'breaking') UNION ALL SELECT project, snapshot_id, 'value_locked', 'warning', path, removed FROM vd WHERE removed <> ''""", EACH)
def impact_check(g):
    return tools.impact_check(more_plans.signature_diff(g), more_plans.value_diff(g), *STEP)


def _vectors(g):
    v = g.table("unit_vectors").select(plain_key(F.col("id")).alias("id"), F.struct("hash", "vec").alias("r"), F.col("built_at").alias("loaded_at")).where("id is not null")
    v = latest(v, ["id"], ["r"]).select("id", F.col("r.vec").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e30))) & F.exists("embedding", lambda x: x != 0)
    v = v.where((F.size("embedding") == 64) & fine)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.select("id", F.transform("embedding", lambda x: x / norm).alias("embedding"), F.xxhash64("id").alias("vec_id"))


@plan(None)
def find_work_area(g):
    """The five nearest units of every twentieth unit, with what the graph knows of them."""
    v = _vectors(g)
    every = F.pmod(F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long"), F.lit(20)) == 0
    top = S.vector_topk_each(v, v.where(every))
    names = v.select("vec_id", "id")
    top = top.join(names, "vec_id").join(names.select(F.col("vec_id").alias("query_id"), F.col("id").alias("qid")), "query_id").select(F.col("qid").alias("query_id"), "id", "score")
    units = _units(g).withColumn("id", plain_key(F.col("id"))).dropDuplicates(["id"])
    return tools.find_work_area(top, units, g.fn_ids())


@plan(None)
def orient(g):
    """Which sections of the overview fit into 4,000 tokens."""
    q = graph_plans.QUERIES
    lines = lambda name: q[name](g.spark, g.root)
    sections = []
    for name in ("zone_map", "debt_summary", "hotspots_min_callers", "routes_listing", "zone_imports"):
        d = lines(name)
        sections.append((name, d.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in d.columns]).alias("line"))))
    return tools.orient(sections, 4000)
