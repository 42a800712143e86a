"""Phrases, zones, caches, retention and rankings over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import phrases as P
from codeloom.functions import text as T
from codeloom.functions.keys import plain_key
from codeloom.operators import detect as D
from codeloom.operators import graph as G
from codeloom.operators import records as C
from codeloom.operators import rules as R
from codeloom.operators import search as S
from codeloom.operators import targets
from codeloom.operators import upkeep as U
from codeloom.operators.snapshots import transitions
from codeloom.plans import more_plans, tool_plans, upkeep_plans
from codeloom.plans.graph_plans import CALLERS, SPLIT
from codeloom.plans.more_plans import _SESS, STEP, _entries, _sessions_commits, _units
from codeloom.plans.views import BASE, EACH, Graph, latest, sql_key
from codeloom.sources import scan

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None, base: str = BASE):
    def add(f):
        QUERIES[f.__name__] = lambda spark, root: f(Graph(spark, root))
        if sql:
            ORACLES[f.__name__] = base + sql
        return f

    return add


_UNITS = "u AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY trim(id) ORDER BY updated_at DESC, source_hash DESC) = 1)"
_TYPE = "CASE WHEN coalesce(p.type_hint, '') <> '' THEN p.type_hint ELSE '?' END"


@plan(f"SELECT fn_id, coalesce(array_to_string(list_transform(params, lambda p: p.name || ':' || {_TYPE}), ','), '') AS key, (CASE WHEN is_async THEN 'async def ' ELSE 'def ' END) || fn_name || '(' || coalesce(array_to_string(list_transform(params, lambda p: p.name || CASE WHEN coalesce(p.type_hint, '') <> '' THEN ': ' || p.type_hint ELSE '' END), ', '), '') || ')' || CASE WHEN return_type IS NOT NULL THEN ' -> ' || return_type ELSE '' END || ':' AS line FROM fn")
def signature_forms(g):
    f = g.functions("fn_name", "params", "return_type", "is_async")
    return f.select("fn_id", P.signature_key(F.col("params")).alias("key"), P.definition_line(F.col("fn_name"), F.col("params"), F.col("return_type"), F.col("is_async")).alias("line"))


@plan("SELECT fn_id, array_to_string(list_transform(list_filter(params, lambda p: p.default_value IS NOT NULL), lambda p: p.name || '=' || CASE WHEN length(p.default_value) > 60 THEN substr(p.default_value, 1, 57) || '...' ELSE p.default_value END), ', ') AS summary FROM fn WHERE len(list_filter(params, lambda p: p.default_value IS NOT NULL)) > 0")
def param_summaries(g):
    return g.functions("params").select("fn_id", P.param_summary(F.col("params")).alias("summary")).where("summary <> ''")


@plan(""", l AS (SELECT source_fn, line, unnest(list_concat(list_transform(regexp_extract_all(expression, '"[^"\\\\\\n]*"|''[^''\\\\\\n]*'''), lambda q: q[2:-2]), regexp_extract_all(regexp_replace(expression, '"[^"\\\\\\n]*"|''[^''\\\\\\n]*''', ' ', 'g'), '(?:^|[^A-Za-z0-9_.-])(-?[0-9]+)\\b', 1))) AS value FROM ed) SELECT value, count(*) AS uses, count(DISTINCT source_fn) AS functions FROM l GROUP BY 1 HAVING count(*) >= 3""")
def frequent_literals(g):
    """Values that stand in at least three calls."""
    l = g.edges().select("source_fn", F.explode(P.call_literals(F.col("expression"))).alias("value"))
    return l.groupBy("value").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("source_fn").alias("functions")).where("uses >= 3")


@plan(f"WITH {_UNITS}, x AS (SELECT trim(id) AS id, unnest(hardcoded_artifacts) AS a FROM u) SELECT DISTINCT id, coalesce(a.value, CASE WHEN len(a.value_list) > 0 THEN CAST(to_json(list_sort(a.value_list)) AS VARCHAR) END) AS value FROM x WHERE coalesce(a.value, CASE WHEN len(a.value_list) > 0 THEN 'x' END) IS NOT NULL", "")
def canonical_artifacts(g):
    a = _units(g).select("id", F.explode("hardcoded_artifacts").alias("a"))
    return a.select("id", P.canonical_value(F.col("a.value"), F.col("a.value_list")).alias("value")).where("value is not null").distinct()


@plan(f"WITH {_UNITS} SELECT trim(id) AS id, md5(array_to_string(list_filter([trim(unit_name), trim(summary), trim(description)], lambda x: x IS NOT NULL AND x <> ''), E'\\n\\n')) AS text_hash FROM u", "")
def unit_texts(g):
    return _units(g).select("id", F.md5(P.embed_text("unit_name", "summary", "description")).alias("text_hash"))


@plan(f"WITH {_UNITS} SELECT trim(id) AS id, unit_name || ': values of ' || len(value_items) || ' value(s) [' || array_to_string(list_transform(value_items[1:6], lambda v: '''' || v || ''''), ', ') || CASE WHEN len(value_items) > 6 THEN ', … (+' || (len(value_items) - 6) || ')' ELSE '' END || ']; referenced by ' || coalesce(consumer_count, 0) || ' function(s) across ' || len(source_files) || ' file(s).' AS summary FROM u WHERE kind = 'value_unit' AND len(value_items) > 0 AND unit_name IS NOT NULL AND len(source_files) >= 0", "")
def value_summaries(g):
    u = _units(g).where("kind = 'value_unit' and size(value_items) > 0 and unit_name is not null and size(source_files) >= 0")
    return u.select("id", P.value_summary(F.col("unit_name"), F.lit("values"), F.col("value_items"), F.coalesce("consumer_count", F.lit(0)), F.size("source_files")).alias("summary"))


_B = "(?:^|[^A-Za-z0-9_])"
_CREATE = "(?i)" + _B + "(?:add|create|implement|write|build|make|introduce|new)\\b.*\\b(?:function|method|class|module|endpoint|route|handler|component|service)\\b"


@plan(f"SELECT doc_id, regexp_matches(coalesce(title, ''), '{_CREATE}') AS creates, left(trim(regexp_replace(coalesce(title, ''), '(?i)\\b(please|can you|could you|i need to|i want to)\\b', '', 'g')), 200) AS intent FROM documents", "")
def title_intents(g):
    return g.table("documents").select("doc_id", P.creation_intent(F.col("title")).alias("creates"), P.intent_words(F.col("title")).alias("intent"))


@plan("SELECT fn_id, CASE WHEN length(s) > 200 THEN left(s, 197) || '...' ELSE s END AS intent FROM (SELECT fn_id, regexp_replace(regexp_replace(intent, '^[\\s\"'']+|[\\s\"'']+$', '', 'g'), '(?s)^(.*?[.。\\n]).*$', '\\1') AS s FROM fn WHERE intent IS NOT NULL)")
def clean_intents(g):
    return g.functions("intent").where("intent is not null").select("fn_id", P.clean_intent(F.col("intent")).alias("intent"))


@plan(", c AS (SELECT DISTINCT project, x.sha AS sha, x.message AS message FROM (SELECT project, unnest(recent_commits) AS x FROM fl)) SELECT sha, message AS old, new FROM (SELECT sha, message, trim(regexp_replace(regexp_replace(message, '^\\s*\\w+\\([^)]*\\)!?:\\s*|^\\s*(?:feat|fix|chore|docs|refactor|test)!?:\\s*', ''), '\\s+', ' ', 'g')) AS new FROM c) WHERE new <> message")
def normalised_commits(g):
    """Commits whose message changes when it is brought into form."""
    c = g.files("recent_commits").select(F.explode("recent_commits").alias("c")).select(F.col("c.sha").alias("sha"), F.col("c.message").alias("old")).distinct()
    return c.withColumn("new", R.commit_message(F.col("old"))).where("new <> old")


@plan(upkeep_plans._CH + """, c AS (SELECT project, snapshot_id, list_sort(list(path)) AS fs, count(*) AS n FROM ch WHERE status <> 'same' GROUP BY 1, 2)
SELECT project, snapshot_id, CASE WHEN length(m) > 72 THEN left(m, 69) || '...' ELSE m END AS message FROM (SELECT *, 'wip: ' || array_to_string(list_transform(fs[1:4], lambda f: string_split(f, '/')[-1]), ', ') || CASE WHEN n > 4 THEN ' (+' || (n - 4) || ' more)' ELSE '' END AS m FROM c)""", EACH)
def fallback_messages(g):
    """A commit message for every step of a project, from the names of its changed files."""
    ch = upkeep_plans._changed(g).where("status <> 'same'")
    n = ch.groupBy(*STEP).agg(F.count(F.lit(1)).alias("n"))
    first = ch.withColumn("r", F.row_number().over(W.partitionBy(*STEP).orderBy("path"))).where("r <= 4").groupBy(*STEP).agg(F.array_sort(F.collect_list("path")).alias("fs"))
    more = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - F.size("fs"), F.lit(1)).cast("int")), lambda i: F.lit("x"))
    files = F.when(F.col("n") > F.size("fs"), F.concat("fs", more)).otherwise(F.col("fs"))
    return first.join(n, list(STEP)).select(*STEP, P.fallback_message(files, F.array().cast("array<string>")).alias("message"))


_SRC = f"src AS (SELECT {sql_key('path')} AS file, string_split(regexp_replace(content, E'\\r\\n?', E'\\n', 'g'), E'\\n') AS ls FROM source_files WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {sql_key('path')} ORDER BY read_at DESC) = 1)"


@plan(f", {_SRC} SELECT fn_id, len(ls[greatest(line_start, 1):least(line_end, len(ls))]) AS n_lines, md5(array_to_string(ls[greatest(line_start, 1):least(line_end, len(ls))], E'\\n')) AS source_hash FROM fn JOIN src USING (file) WHERE line_end - line_start < 200")
def source_slices(g):
    """The source of every function of at most 200 lines, as its number of lines and hash."""
    from codeloom.plans.source_plans import _files

    f = g.functions("line_start", "line_end").where("line_end - line_start < 200").join(_files(g.spark, g.root).where("content is not null").select(F.col("path").alias("file"), "content"), "file")
    lines = P.source_lines(F.col("content"), F.col("line_start"), F.col("line_end"))
    return f.select("fn_id", F.size(lines).alias("n_lines"), F.md5(P.head_and_tail(lines)).alias("source_hash"))


@plan("SELECT DISTINCT coalesce(nullif(replace(regexp_replace(trim(coalesce(session_id, '')), '[/\\\\]', '_', 'g'), '..', '_'), ''), 'unknown') AS name FROM transcript", "")
def safe_session_names(g):
    return g.table("transcript").select(P.safe_name(F.col("session_id")).alias("name")).distinct()


@plan("WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b([0-9]{1,4}\\.[0-9]{1,4}\\.[0-9]{1,4})\\b', 1)) AS v FROM documents WHERE source = 'changelog') SELECT doc_id, array_to_string(max(list_transform(string_split(v, '.'), lambda x: x::int)), '.') AS newest FROM v GROUP BY 1", "")
def newest_versions(g):
    v = g.table("documents").where("source = 'changelog'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,4}\.[0-9]{1,4}\.[0-9]{1,4})\b"), F.lit(1))).alias("v"))
    return v.groupBy("doc_id").agg(F.max(P.version_numbers(F.col("v"))).alias("m")).select("doc_id", F.array_join(F.transform("m", lambda x: x.cast("string")), ".").alias("newest"))


@plan(""", r AS (SELECT project, path, string_split(CASE WHEN starts_with(path, project || '/') THEN substr(path, length(project) + 2) ELSE path END, '/') AS p FROM fl), d AS (SELECT *, p[1:-2] AS d, CASE WHEN len(p) > 1 THEN p[1] END AS top FROM r),
e AS (SELECT project, top, min(d) AS lo, max(d) AS hi FROM d WHERE top IS NOT NULL GROUP BY 1, 2), s AS (SELECT project, top, len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])) AS shared FROM e)
SELECT path, CASE WHEN d.top IS NULL THEN regexp_replace(p[1], '\\.[^.]*$', '') WHEN shared <= 1 THEN d.top WHEN len(d.d) > shared THEN d.d[shared + 1] ELSE 'core' END AS zone FROM d LEFT JOIN s ON s.project = d.project AND s.top = d.top""")
def zone_assignment(g):
    return D.zones(g.files("project"))


_CYR = "length(regexp_replace(description, '[^Ѐ-ӿ]', '', 'g'))::double / length(description)"


@plan(f"SELECT {sql_key('fn_id')} AS fn_id, count(*) AS reports FROM impact_reports WHERE trim(coalesce(description, '')) <> '' AND {_CYR} < 0.05 AND fn_id IS NOT NULL GROUP BY 1", "")
def reusable_reports(g):
    """Functions with reports that can be used again: described, and not in Cyrillic."""
    r = g.table("impact_reports").where("trim(coalesce(description, '')) <> '' and fn_id is not null").where(T.cyrillic_share(F.col("description")) < 0.05)
    return r.groupBy(plain_key(F.col("fn_id")).alias("fn_id")).agg(F.count(F.lit(1)).alias("reports"))


@plan("SELECT project, avg(c)::double >= 0.2 AS cyrillic FROM (SELECT project, CASE WHEN length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g'))::double / length(text) >= 0.05 THEN 1 ELSE 0 END AS c FROM documents WHERE length(text) > 0 AND project IS NOT NULL) GROUP BY 1", "")
def project_languages(g):
    """Projects of which at least a fifth of the texts are in Cyrillic; all texts are looked at."""
    d = g.table("documents").where("length(text) > 0 and project is not null").select("project", (T.cyrillic_share(F.col("text")) >= 0.05).cast("int").alias("c"))
    return d.groupBy("project").agg((F.avg("c") >= 0.2).alias("cyrillic"))


@plan("""WITH s AS (SELECT project, snapshot_id, min(snapshot_ts) AS a FROM graph_files GROUP BY 1, 2), i AS (SELECT project, snapshot_id, strftime(a, '%Y-%m-%d') AS a, coalesce(strftime(lead(a) OVER (PARTITION BY project ORDER BY snapshot_id), '%Y-%m-%d'), '9999') AS b FROM s),
c AS (SELECT DISTINCT project, x.sha AS sha, x.commit_date AS d FROM (SELECT project, unnest(recent_commits) AS x FROM graph_files))
SELECT project, snapshot_id, sha FROM i JOIN c USING (project) WHERE d >= a AND d < b QUALIFY row_number() OVER (PARTITION BY project, snapshot_id ORDER BY d DESC, sha) <= 10""", "")
def snapshot_commits(g):
    """The last ten commits between a snapshot and the next of its project, by date."""
    f = g.table("graph_files")
    s = f.groupBy("project", "snapshot_id").agg(F.min("snapshot_ts").alias("t"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    s = s.select("project", "snapshot_id", day("t").alias("a"), F.coalesce(F.lead(day("t")).over(W.partitionBy("project").orderBy("snapshot_id")), F.lit("9999")).alias("b"))
    c = f.select("project", F.explode("recent_commits").alias("x")).select("project", F.col("x.sha").alias("sha"), F.col("x.commit_date").alias("d")).distinct()
    hit = s.join(c, "project").where("d >= a and d < b")
    return hit.withColumn("r", F.row_number().over(W.partitionBy("project", "snapshot_id").orderBy(F.desc("d"), "sha"))).where("r <= 10").select("project", "snapshot_id", "sha")


@plan(", w AS (SELECT DISTINCT raw FROM (SELECT target_fn AS raw FROM ed UNION ALL SELECT split_part(target_fn, '::', 2) FROM ed)), e AS (SELECT raw, fn_id FROM w JOIN fn ON fn_id = raw), n AS (SELECT fn_name AS raw, min(fn_id) AS fn_id FROM fn GROUP BY 1 HAVING count(*) = 1) SELECT * FROM e UNION ALL SELECT w.raw, n.fn_id FROM w ANTI JOIN e USING (raw) JOIN n USING (raw)")
def functions_by_name(g):
    e = g.edges()
    w = e.select(F.explode(F.array("target_fn", F.split_part("target_fn", F.lit("::"), F.lit(2)))).alias("raw")).distinct()
    return targets.function_by_name(w, g.functions("fn_name"))


@plan("""SELECT DISTINCT zone, zone_imports_from AS imports_from, zone_imported_by AS imported_by FROM (WITH z AS (SELECT path, coalesce(zone_name, 'unknown') AS zone FROM fl), x AS (SELECT a.zone AS f, b.zone AS t FROM im JOIN z a ON a.path = source_file JOIN z b ON b.path = target_file WHERE a.zone <> b.zone)
SELECT z.zone, coalesce((SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM x WHERE f = z.zone), '') AS zone_imports_from, coalesce((SELECT string_agg(DISTINCT f, ',' ORDER BY f) FROM x WHERE t = z.zone), '') AS zone_imported_by FROM z)""")
def zone_neighbours(g):
    """Per zone the zones it imports from and those that import from it."""
    pairs = G.zone_imports(g.imports(), g.files("zone_name"))
    names = lambda a, b, c: pairs.groupBy(F.col(a).alias("zone")).agg(F.array_join(F.array_sort(F.collect_set(b)), ",").alias(c))
    z = g.files("zone_name").select(F.coalesce("zone_name", F.lit("unknown")).alias("zone")).distinct()
    return z.join(names("from_zone", "to_zone", "imports_from"), "zone", "left").join(names("to_zone", "from_zone", "imported_by"), "zone", "left").fillna("", ["imports_from", "imported_by"])


@plan("SELECT category, count(*) AS n, count(*) FILTER (severity = 'high') AS high FROM (" + """SELECT 'complexity' AS category, CASE WHEN complexity >= 15 THEN 'high' WHEN complexity >= 10 THEN 'medium' END AS severity FROM fn
UNION ALL SELECT 'long_function', CASE WHEN line_count >= 100 THEN 'high' WHEN line_count >= 50 THEN 'medium' END FROM fn UNION ALL SELECT 'monster_file', CASE WHEN coalesce(len(function_ids), 0) >= 30 THEN 'high' WHEN coalesce(len(function_ids), 0) >= 15 THEN 'medium' END FROM fl
UNION ALL SELECT 'circular_import', 'medium' FROM im a JOIN im b ON a.source_file = b.target_file AND a.target_file = b.source_file WHERE a.source_file < a.target_file) WHERE severity IS NOT NULL GROUP BY 1""")
def debt_by_category(g):
    items = G.debt_items(g.functions("complexity", "line_count"), g.files("function_ids"), g.imports())
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "high").alias("high"))


@plan(upkeep_plans.ORACLES["modified_functions"].removeprefix(EACH).replace("SELECT project, snapshot_id, fn_id, file FROM fnew f", ", m AS (SELECT project, snapshot_id, fn_id, complexity FROM fnew f") + ") SELECT project, snapshot_id, count(*) AS n, floor(avg(complexity) * 100 + 0.5) / 100 AS average FROM m GROUP BY 1, 2 HAVING avg(complexity) > 3", EACH)
def complex_changes(g):
    f = transitions(g.functions_each("complexity"), g.calendar())[1]
    return C.complex_changes(f, upkeep_plans.modified_functions(g), *STEP, limit=3.0).withColumn("average", T.round_half_up(F.col("average"), 2))


@plan(f"""SELECT project, zone, file, array_to_string(list_sort(list(fn_name))[1:30], ',') AS names FROM (SELECT fn.project, coalesce(zone_name, 'unknown') AS zone, file, fn_name FROM fn JOIN fl ON fl.path = fn.file) GROUP BY 1, 2, 3""")
def project_summary(g):
    """Per project, zone and file the first thirty function names."""
    z = g.files("zone_name").select(F.col("path").alias("file"), F.coalesce("zone_name", F.lit("unknown")).alias("zone"))
    f = g.functions("fn_name").withColumn("r", F.row_number().over(W.partitionBy("file").orderBy("fn_name"))).where("r <= 30")
    return f.join(z, "file").groupBy("project", "zone", "file").agg(F.array_join(F.array_sort(F.collect_list("fn_name")), ",").alias("names"))


@plan("SELECT count(*) AS reports, count(*) FILTER (trim(coalesce(description, '')) <> '') AS analysed, count(*) FILTER (trim(coalesce(description, '')) = '') AS skipped, count(*) FILTER (risk_score IS NULL) AS failed FROM impact_reports", "")
def impact_meta(g):
    empty = F.trim(F.coalesce("description", F.lit(""))) == ""
    return g.table("impact_reports").agg(F.count(F.lit(1)).alias("reports"), F.count_if(~empty).alias("analysed"), F.count_if(empty).alias("skipped"), F.count_if(F.col("risk_score").isNull()).alias("failed"))


@plan("""WITH s AS (SELECT session_id, max(project) AS project, min(t) AS st FROM (SELECT lower(regexp_replace(session_id, '[\\s{}]+', '', 'g')) AS session_id, string_split(replace(cwd, '\\', '/'), '/')[-1] AS project, try_cast(ts AS TIMESTAMPTZ) AS t FROM transcript WHERE session_id IS NOT NULL) GROUP BY 1 HAVING min(t) IS NOT NULL),
l AS (SELECT s.* FROM s JOIN (SELECT project, max(st) AS mx FROM s GROUP BY 1) m USING (project) WHERE st > mx - INTERVAL 7 DAY) SELECT project, session_id FROM l QUALIFY row_number() OVER (PARTITION BY project ORDER BY st DESC, session_id) <= 50""", "")
def session_retention(g):
    return C.retained_sessions(_sessions_commits(g)[0]).select("project", "session_id")


@plan(CALLERS + ", p AS (SELECT wc.fn_id, fn_name, callers, row_number() OVER (ORDER BY wc.fn_id) AS r, count(*) OVER () AS total FROM wc JOIN fl ON fl.path = wc.file WHERE zone_name = 'core') SELECT fn_id, fn_name, callers, total, CASE WHEN total > 30 THEN 30 END AS next_offset FROM p WHERE r > 10 AND r <= 30")
def browse_page_with_total(g):
    """A page of the functions of a zone with their number and where the next page begins."""
    z = g.files("zone_name").where("zone_name = 'core'").select(F.col("path").alias("file"))
    rows = G.with_callers(g.functions("fn_name"), g.edges()).join(z, "file")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.select("fn_id", "fn_name", "callers").orderBy("fn_id").offset(10).limit(20)
    return page.crossJoin(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > 30, 30))


@plan(CALLERS + ", e AS (SELECT DISTINCT source_fn, target_fn FROM ed) SELECT target_fn AS fn_id, source_fn AS caller, coalesce(wc.callers, 0) AS fan_in, r AS rank FROM (SELECT e.*, coalesce(wc.callers, 0) AS callers, row_number() OVER (PARTITION BY target_fn ORDER BY coalesce(wc.callers, 0) DESC, source_fn)::int AS r FROM e JOIN wc ON wc.fn_id = source_fn) wc WHERE r <= 8")
def ranked_callers(g):
    """The eight callers of each function that are called most themselves."""
    e = g.edges()
    fan = G.with_callers(g.fn_ids(), e).select(F.col("fn_id").alias("source_fn"), F.col("callers").alias("fan_in"))
    rows = e.select("source_fn", "target_fn").distinct().join(fan, "source_fn")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("target_fn").orderBy(F.desc("fan_in"), "source_fn"))).where("rank <= 8")
    return rows.select(F.col("target_fn").alias("fn_id"), F.col("source_fn").alias("caller"), "fan_in", "rank")


_H48 = "('0x' || left(sha256({c}), 12))::bigint::hugeint"


@plan(f", e AS (SELECT DISTINCT source_fn, target_fn FROM ed), c AS (SELECT target_fn AS fn_id, sum({_H48.format(c='source_fn')})::varchar AS k FROM e GROUP BY 1) SELECT fn_id, ast_hash || ':' || coalesce(k, '0') AS content_hash, 'analyse' AS state FROM fn LEFT JOIN c USING (fn_id) WHERE ast_hash IS NOT NULL")
def impact_cache(g):
    stored = g.table("impact_reports").select(plain_key(F.col("fn_id")).alias("fn_id"), "content_hash").where("fn_id is not null").groupBy("fn_id").agg(F.max("content_hash").alias("content_hash"))
    return C.impact_cache(g.functions("ast_hash"), g.edges(), stored)


@plan(f", h AS (SELECT DISTINCT project, source_hash FROM fl WHERE source_hash IS NOT NULL) SELECT project, sum({_H48.format(c='source_hash')})::varchar AS graph_hash FROM h GROUP BY 1")
def graph_hashes(g):
    """One hash per project that changes with any of its files."""
    return C.set_hash(g.files("source_hash"), ["project"], "source_hash", "graph_hash")


@plan(f", {_UNITS} SELECT trim(u.id) AS id, CASE WHEN fl.path IS NULL THEN 'orphan' WHEN u.source_hash IS NULL OR fl.source_hash IS NULL THEN 'unknown' WHEN u.source_hash = fl.source_hash THEN 'fresh' ELSE 'stale' END AS state FROM u LEFT JOIN fl ON fl.path = {sql_key('u.source_files[1]')}")
def stale_units(g):
    """Units by the hash of their first file: fresh, stale, orphan or unknown."""
    u = _units(g, True).select("id", F.col("source_hash").alias("own"), plain_key(F.get("source_files", F.lit(0))).alias("path"))
    j = u.join(g.files("source_hash").select("path", F.col("source_hash").alias("now"), F.lit(True).alias("live")), "path", "left")
    state = F.when(F.col("live").isNull(), "orphan").when(F.col("own").isNull() | F.col("now").isNull(), "unknown").when(F.col("own") == F.col("now"), "fresh").otherwise("stale")
    return j.select("id", state.alias("state"))


@plan(f"SELECT fn_id FROM fn WHERE fn_id NOT IN (SELECT {sql_key('fn_id')} FROM impact_reports WHERE {sql_key('fn_id')} IS NOT NULL)")
def unanalysed_functions(g):
    return C.unanalysed(g.fn_ids().select("fn_id"), g.table("impact_reports").select(plain_key(F.col("fn_id")).alias("fn_id")), "fn_id")


@plan(None)
def embed_refresh(g):
    """The vector index brought up to date, with vectors of a hashing encoder for new and changed units."""
    u = _units(g, True).select(plain_key(F.col("id")).alias("id"), F.col("source_hash").alias("hash"), P.embed_text("unit_name", "summary", "description").alias("text"))
    s = g.table("unit_vectors").groupBy(plain_key(F.col("id")).alias("id")).agg(F.max(F.struct("built_at", "hash", "vec")).alias("m")).select("id", "m.hash", "m.vec")
    return C.refresh_vectors(s, u.groupBy("id").agg(F.max(F.struct("hash", "text")).alias("m")).select("id", "m.hash", "m.text"), R.hash_encoder())


@plan(None)
def detected_rules(g):
    from codeloom.plans.source_plans import _files

    return D.detected_rules(_files(g.spark, g.root))


@plan(", m AS (SELECT file, class_name, project, fn_name, row_number() OVER (PARTITION BY file, class_name ORDER BY line_start, fn_id) AS r, count(*) OVER (PARTITION BY file, class_name) AS n FROM fn WHERE class_name IS NOT NULL) SELECT file, class_name, max(n) AS n_methods, string_agg(fn_name, ',' ORDER BY r) AS methods FROM m WHERE r <= 12 GROUP BY 1, 2")
def class_outlines(g):
    """The first twelve methods of every class."""
    f = g.functions("class_name", "fn_name", "line_start").where("class_name is not null")
    n = f.groupBy("file", "class_name").agg(F.count(F.lit(1)).alias("n_methods"))
    top = f.withColumn("r", F.row_number().over(W.partitionBy("file", "class_name").orderBy("line_start", "fn_id"))).where("r <= 12")
    names = top.groupBy("file", "class_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "fn_name"))), lambda x: x["fn_name"]), ",").alias("methods"))
    return n.join(names, ["file", "class_name"])


@plan(_SESS + "SELECT session_id, name, count(*) AS calls FROM cl WHERE name IS NOT NULL GROUP BY 1, 2", "")
def session_tools(g):
    from codeloom.operators import sessions as N

    return N.tool_calls(_entries(g)).where("name is not null").groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("calls"))


@plan(_SESS + "SELECT session_id, min_by(json_extract_string(message, '$.model'), t) FILTER (kind = 'assistant' AND json_extract_string(message, '$.model') IS NOT NULL AND t IS NOT NULL) AS model FROM e GROUP BY 1", "")
def session_models(g):
    m = F.when((F.col("kind") == "assistant") & F.col("msg.model").isNotNull() & F.col("t").isNotNull(), F.col("t"))
    return _entries(g).groupBy("session_id").agg(F.min_by("msg.model", m).alias("model"))


@plan("SELECT snapshot_id, kind, n, text FROM (WITH x AS (" + upkeep_plans.ORACLES["audit_packet"].removeprefix(EACH) .lstrip(", ").replace("n AS (SELECT t.*", "WITH n AS (SELECT t.*", 1) + "), k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, kind ORDER BY id, reason) AS r, count(*) OVER (PARTITION BY snapshot_id, kind) AS n FROM x) SELECT snapshot_id, kind, max(n) AS n, string_agg('- ' || id || ' (' || reason || ')', E'\\n' ORDER BY r) AS text FROM k WHERE r <= 10 GROUP BY 1, 2)", EACH)
def audit_listing(g):
    """The audit of each step as lines, the first ten per kind of unit."""
    a = upkeep_plans.audit_packet(g)
    n = a.groupBy("snapshot_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = a.withColumn("r", F.row_number().over(W.partitionBy("snapshot_id", "kind").orderBy("id", "reason"))).where("r <= 10")
    text = top.groupBy("snapshot_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("- "), "id", F.lit(" ("), "reason", F.lit(")")).alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return n.join(text, ["snapshot_id", "kind"])


@plan(None)
def source_class_summaries(g):
    from codeloom.plans.source_plans import _files
    from codeloom.sources import facts

    f = _files(g.spark, g.root)
    sizes = scan.class_sizes(f, facts.functions(f))
    return facts.classes(f).join(sizes, ["path", "class_name"]).select("path", "class_name", P.class_summary(F.col("class_name"), F.col("line_start"), F.col("line_end"), F.col("n_methods"), F.col("n_attributes"), F.col("bases")).alias("summary"))


# the terms of the intent are those of intent_search; callers of every function it could find
_REUSE = "collect the harvest and the meter for each ticket"


@plan(f""", q AS (SELECT list_distinct({more_plans._tokens_sql("'" + _REUSE + "'")}) AS q), up AS (SELECT DISTINCT target_fn AS fn_id, source_fn AS upstream FROM ed WHERE target_fn IN (SELECT fn_id FROM fn)),
s AS (SELECT fn_id AS upstream, list_distinct({more_plans._stems("flatten(list_transform(params, lambda p: " + SPLIT.format(c="p.name") + "))")}) AS stems FROM fn)
SELECT fn_id, upstream, params FROM (SELECT fn_id, upstream, array_to_string(list_sort(list_intersect(stems, q)), ',') AS params FROM up JOIN s USING (upstream), q) WHERE params <> ''""")
def reuse_suggestions(g):
    return S.reuse_suggestions(g.fn_ids(), g.functions("params"), g.edges(), _REUSE)


@plan("SELECT fn_id, fn_name, intent FROM fn WHERE intent IS NOT NULL ORDER BY sha256(fn_id || 'eval'), fn_id LIMIT 50")
def intent_sample(g):
    """Fifty intents to look at, chosen by hash so that the choice can be repeated."""
    return g.functions("fn_name", "intent").where("intent is not null").orderBy(F.sha2(F.concat("fn_id", F.lit("eval")), 256), "fn_id").limit(50).select("fn_id", "fn_name", "intent")


@plan("SELECT fn_id, 'Function: ' || fn_name || E'\\nFile: ' || file || E'\\nCallers: ' || callers || E'\\nComplexity: ' || coalesce(complexity, 0) || E'\\nDocumentation: ' || coalesce(docstring, 'none') AS prompt FROM wc WHERE intent IS NULL", BASE + CALLERS)
def intent_prompts(g):
    """What a provider of intents is told of every function without one."""
    f = G.with_callers(g.functions("fn_name", "complexity", "docstring", "intent").where("intent is null"), g.edges())
    lines = [("Function: ", "fn_name"), ("\nFile: ", "file"), ("\nCallers: ", "callers")]
    text = [x for a, b in lines for x in (F.lit(a), F.col(b).cast("string"))]
    return f.select("fn_id", F.concat(*text, F.lit("\nComplexity: "), F.coalesce("complexity", F.lit(0)).cast("string"), F.lit("\nDocumentation: "), F.coalesce("docstring", F.lit("none"))).alias("prompt"))


@plan(f", {_UNITS}, r AS (SELECT {sql_key('fn_id')} AS id, risk_level FROM impact_reports WHERE {sql_key('fn_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {sql_key('fn_id')} ORDER BY generated_at DESC) = 1), k AS (SELECT {sql_key('id')} AS id, min(kind) AS kind FROM u GROUP BY 1) SELECT coalesce(r.id, k.id) AS id, kind, risk_level FROM k FULL JOIN r ON r.id = k.id")
def reports_and_units(g):
    """Impact reports and units side by side."""
    r = g.table("impact_reports").select(plain_key(F.col("fn_id")).alias("id"), "risk_level", F.col("generated_at").alias("loaded_at")).where("id is not null")
    u = _units(g).groupBy(plain_key(F.col("id")).alias("id")).agg(F.min("kind").alias("kind"))
    return u.join(latest(r, ["id"], ["risk_level"]), "id", "full").select("id", "kind", "risk_level")


@plan(tool_plans.ORACLES["impact_check"].removeprefix(EACH).replace("SELECT project, snapshot_id, 'broken_caller' AS warning", ", w AS (SELECT project, snapshot_id, 'broken_caller' AS warning", 1) + ") SELECT w.project, w.snapshot_id, w.target, e.source_fn, e.site_file, e.line FROM w JOIN ea e ON e.project = w.project AND e.snapshot_id = w.snapshot_id AND e.target_fn = w.target WHERE warning = 'broken_caller' GROUP BY ALL", EACH)
def broken_call_sites(g):
    """Where functions that a step broke are still called."""
    w = tool_plans.impact_check(g).where("warning = 'broken_caller'").select(*STEP, "target")
    e = g.edges_each().select(*STEP, F.col("target_fn").alias("target"), "source_fn", "site_file", "line")
    return w.join(e, [*STEP, "target"]).distinct()


@plan(""", roots AS (SELECT project, coalesce(min(path) FILTER (string_split(path, '/')[-1] IN ('app.py', 'main.py', 'manage.py', 'wsgi.py', 'asgi.py', '__main__.py', 'server.py', 'run.py')), min(path)) AS root FROM fl GROUP BY 1),
walk AS (SELECT root AS path, 0 AS depth FROM roots UNION ALL SELECT i.target_file, w.depth + 1 FROM walk w JOIN im i ON i.source_file = w.path WHERE w.depth < 2), cd AS (SELECT target_fn AS fn_id, count(*) AS callers FROM ed GROUP BY 1), z AS (SELECT path AS file, coalesce(zone_name, 'unknown') AS zone FROM fl)
SELECT z.zone, count(DISTINCT z.file) AS n_files, count(fn.fn_id) AS n_functions, count(fn.route) AS n_routes, count(*) FILTER (coalesce(cd.callers, 0) > 0) AS n_locked, count(DISTINCT z.file) FILTER (z.file IN (SELECT path FROM walk)) AS n_startup FROM z LEFT JOIN fn USING (file) LEFT JOIN cd USING (fn_id) GROUP BY 1""")
def zone_map_with_startup(g):
    start = G.bounded_bfs(g.imports(), G.entry_points(g.files("project")), 2)
    return G.zone_map(g.functions("route"), g.edges(), g.files("zone_name"), start)


@plan(_SESS + ", p AS (SELECT session_id, t, json_extract_string(message, '$.content') AS said FROM e WHERE kind = 'user' AND t IS NOT NULL AND json_type(message, '$.content') = 'VARCHAR' AND length(json_extract_string(message, '$.content')) > 2) SELECT session_id, min(said) AS first_prompt FROM p JOIN (SELECT session_id, min(t) AS t FROM p GROUP BY 1) m USING (session_id, t) GROUP BY 1", "")
def session_prompts(g):
    """The first text a user wrote in each session; of equal times the smaller."""
    e = _entries(g)
    text = (F.col("kind") == "user") & (F.schema_of_variant(F.try_variant_get(F.try_parse_json("message"), "$.content", "variant")) == "STRING") & F.col("t").isNotNull() & (F.length("content") > 2)
    return e.where(text).groupBy("session_id").agg(F.min(F.struct("t", "content")).alias("m")).select("session_id", F.col("m.content").alias("first_prompt"))
