"""Search, difference, session and literal queries, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.keys import blank_to_null, plain_key
from codeloom.operators import graph as G
from codeloom.operators import incremental as I
from codeloom.operators import literals as L
from codeloom.operators import search as S
from codeloom.operators import sessions as N
from codeloom.plans.graph_plans import CALLERS, SPLIT
from codeloom.operators.snapshots import p6_found, transitions
from codeloom.plans.problem_sql import P6
from codeloom.plans.views import BASE, EACH, Graph, sides, sql_key
from codeloom.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None, base: str = BASE):
    def add(f):
        QUERIES[f.__name__] = lambda spark, root: f(Graph(spark, root))
        if sql:
            ORACLES[f.__name__] = base + sql
        return f

    return add


def _stem_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) - {len(s)} >= {k} THEN left({w}, length({w}) - {len(s)})" for s, k in T.SUFFIXES) + f" ELSE {w} END"


def _stems(xs: str) -> str:
    return f"list_transform({xs}, lambda w: {_stem_sql('w')})"


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tokens_sql(c: str) -> str:
    words = f"flatten(list_transform(regexp_extract_all(coalesce({c}, ''), '[a-zA-Z][a-zA-Z0-9]*'), lambda x: {SPLIT.format(c='x')}))"
    return _stems(f"list_filter({words}, lambda w: w NOT IN ({_STOP}))")


INTENT = "sort the meter readings when the session ends"
_SIG = _stems(f"list_concat({SPLIT.format(c='fn_name')}, flatten(list_transform(coalesce(params, []), lambda p: list_concat({SPLIT.format(c='p.name')}, {SPLIT.format(c='p.type_hint')}))), {SPLIT.format(c='return_type')})")


@plan(CALLERS + f""", q AS (SELECT list_distinct({_tokens_sql("'" + INTENT + "'")}) AS q),
s AS (SELECT fn_id, callers, (len(list_intersect(q, {_stems(SPLIT.format(c='fn_name'))}))::double / len(q) * 0.5 + len(list_intersect(q, list_concat({_SIG}, {_tokens_sql('docstring')})))::double / len(q) * 0.3 + len(list_intersect(q, {_tokens_sql('intent')}))::double / len(q) * 0.4) * CASE WHEN callers >= 3 THEN 1.1::double ELSE 1 END AS s FROM wc, q)
SELECT fn_id, floor(s * 1000 + 0.5) / 1000 AS score, callers FROM s WHERE s >= 0.2 ORDER BY score DESC, fn_id LIMIT 5""")
def intent_search(g):
    return S.intent_search(g.functions("fn_name", "params", "return_type", "docstring", "intent"), G.callers_degree(g.edges()), INTENT)


_WORDS = _stems("regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')")


@plan(f"SELECT doc_id, CASE WHEN list_has_any({_WORDS}, {_stems(str(S.CHANGE))}) THEN 'change' WHEN list_has_any({_WORDS}, {_stems(str(S.CREATE))}) THEN 'create' ELSE 'unknown' END AS category FROM documents", "")
def intent_category(g):
    return table(g.spark, g.root, "documents").select("doc_id", S.intent_category(F.col("text")).alias("category"))


@plan("SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_./-]+\\.(?:py|ts|js|java|go|rs|cs)')) AS path FROM documents", "")
def explicit_targets(g):
    return table(g.spark, g.root, "documents").select("doc_id", F.explode(S.explicit_paths(F.col("text"))).alias("path"))


@plan(", w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents) SELECT doc_id, name FROM w WHERE name IN (SELECT fn_name FROM fn WHERE length(fn_name) >= 4)")
def dictionary_match(g):
    return S.dictionary_matches(table(g.spark, g.root, "documents"), g.functions("fn_name").select(F.col("fn_name").alias("name")))


TOPK_EACH = "WITH q AS (SELECT vec_id AS query_id, embedding::double[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, floor(list_dot_product(embedding::double[], q) * 10000 + 0.5) / 10000 AS score FROM embeddings, q WHERE vec_id <> query_id), top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5) "


def _top_each(g):
    v = table(g.spark, g.root, "embeddings")
    return S.vector_topk_each(v, v.where("vec_id % 20 = 0"))


@plan(TOPK_EACH + "SELECT query_id, vec_id, score FROM top", "")
def vector_topk(g):
    return _top_each(g)


@plan(TOPK_EACH + "SELECT query_id, CASE WHEN best >= 0.55 OR (best >= 0.45 AND best - last >= 0.05) THEN 'OK' ELSE 'NO_CLEAR_MATCH' END AS verdict, CASE WHEN best >= 0.55 THEN 'high' WHEN best >= 0.45 AND best - last >= 0.05 THEN 'medium' ELSE 'low' END AS confidence, best FROM (SELECT query_id, max(score) AS best, min(score) AS last FROM top GROUP BY 1)", "")
def vector_verdict(g):
    return S.vector_verdict(_top_each(g), "query_id")


# Differences between each delivered snapshot of a project and its previous one; snapshot_id is the later.
STEP = ("project", "snapshot_id")
_SIGNED = ", '(' || coalesce(array_to_string(list_transform(params, lambda p: p.name || CASE WHEN coalesce(p.type_hint, '') <> '' THEN ': ' || p.type_hint ELSE '' END), ', '), '') || ')' || CASE WHEN return_type IS NOT NULL THEN ' -> ' || return_type ELSE '' END AS s"


@plan(sides("fa") + f""", os AS (SELECT project, snapshot_id, fn_id {_SIGNED} FROM o), ns AS (SELECT project, snapshot_id, fn_id {_SIGNED} FROM n),
cl AS (SELECT project, snapshot_id, target_fn AS fn_id, count(*) AS callers FROM ea GROUP BY 1, 2, 3)
SELECT project, snapshot_id, fn_id, CASE WHEN os.s IS NULL THEN 'added' WHEN ns.s IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN os.s IS NOT NULL AND ns.s IS NOT NULL THEN CASE WHEN starts_with(ns.s, split_part(os.s, ')', 1)) THEN 'additive' ELSE 'breaking' END END AS note, coalesce(callers, 0) AS callers FROM os FULL JOIN ns USING (project, snapshot_id, fn_id) LEFT JOIN cl USING (project, snapshot_id, fn_id) WHERE os.s IS DISTINCT FROM ns.s""", EACH)
def signature_diff(g):
    calls = g.edges_each().groupBy(*STEP, F.col("target_fn").alias("fn_id")).agg(F.count(F.lit(1)).alias("callers"))
    return I.signature_diff(*transitions(g.functions_each("params", "return_type"), g.calendar()), calls, *STEP)


@plan(sides("fa") + ", a AS (SELECT project, snapshot_id, sum(complexity)::bigint AS c, max(line_count) AS m, count(*) AS k FROM n GROUP BY 1, 2), b AS (SELECT project, snapshot_id, sum(complexity)::bigint AS c, count(*) AS k FROM o GROUP BY 1, 2) SELECT project, snapshot_id, coalesce(a.c, 0) - coalesce(b.c, 0) AS complexity_delta, m AS max_function_lines, coalesce(a.k, 0) - coalesce(b.k, 0) AS functions_delta FROM a FULL JOIN b USING (project, snapshot_id)", EACH)
def debt_delta(g):
    return I.debt_delta(*transitions(g.functions_each("complexity", "line_count"), g.calendar()), *STEP)


@plan(sides("pa") + """, j AS (SELECT project, snapshot_id, n.path IS NOT NULL AS has, o.path IS NOT NULL AS had, coalesce(n.lines_of_code, 0) - coalesce(o.lines_of_code, 0) AS grown, coalesce(len(list_distinct(n.imports)), 0) - coalesce(len(list_distinct(o.imports)), 0) AS di FROM n FULL JOIN o USING (project, snapshot_id, path))
SELECT project, snapshot_id, max(CASE WHEN has THEN greatest(grown, 0) ELSE 0 END) AS biggest_file_growth, sum(di)::bigint AS import_edges_delta, count(*) FILTER (has AND NOT had) AS files_created FROM j GROUP BY 1, 2""", EACH)
def file_growth(g):
    return I.file_growth(*transitions(g.files_each("lines_of_code", "imports"), g.calendar()), *STEP)


@plan(sides("pa") + "SELECT * FROM (SELECT project, snapshot_id, path, array_to_string(list_sort(list_distinct(list_filter(n.ids, lambda x: NOT list_contains(o.ids, x)))), '|') AS added, array_to_string(list_sort(list_distinct(list_filter(o.ids, lambda x: NOT list_contains(n.ids, x)))), '|') AS removed FROM o JOIN n USING (project, snapshot_id, path)) WHERE added <> '' OR removed <> ''", EACH)
def value_diff(g):
    return I.value_diff(*transitions(g.files_each("function_ids"), g.calendar()), "path", "function_ids", *STEP)


_SUMS = ["n_functions", "complexity", "n_edges", "n_files", "debt_score"]


@plan(f""", f AS (SELECT project, snapshot_id, count(*) AS n_functions, sum(complexity)::bigint AS complexity, 3 * (count(*) FILTER (complexity >= 15) + count(*) FILTER (line_count >= 100)) + count(*) FILTER (complexity BETWEEN 10 AND 14) + count(*) FILTER (line_count BETWEEN 50 AND 99) AS d1 FROM fa GROUP BY 1, 2),
e AS (SELECT project, snapshot_id, count(*) AS n_edges FROM ea GROUP BY 1, 2), p AS (SELECT project, snapshot_id, count(*) AS n_files, 3 * count(*) FILTER (len(ids) >= 30) + count(*) FILTER (len(ids) BETWEEN 15 AND 29) AS d2 FROM pa GROUP BY 1, 2),
r AS (SELECT project, snapshot_id, coalesce(n_functions, 0) AS n_functions, coalesce(complexity, 0) AS complexity, coalesce(n_edges, 0) AS n_edges, coalesce(n_files, 0) AS n_files, coalesce(d1, 0) + coalesce(d2, 0) AS debt_score FROM cal LEFT JOIN f USING (project, snapshot_id) LEFT JOIN e USING (project, snapshot_id) LEFT JOIN p USING (project, snapshot_id)),
d AS (SELECT *, {", ".join(f"coalesce({c} - lag({c}) OVER w, 0) AS d_{c}" for c in _SUMS)} FROM r WINDOW w AS (PARTITION BY project ORDER BY snapshot_id))
SELECT snapshot_id, count(*) AS n_projects, {", ".join(f"sum({c})::bigint AS {c}, sum(d_{c})::bigint AS d_{c}" for c in _SUMS)} FROM d GROUP BY 1""", EACH)
def snapshot_history(g):
    return I.snapshot_history(g.functions_each("complexity", "line_count"), g.edges_each(), g.files_each("function_ids"), g.calendar())


@plan(f"WITH ch AS ({P6}), k AS (SELECT *, CASE WHEN key_b <> '' THEN key_a || ' -> ' || key_b ELSE key_a END AS key FROM ch) SELECT entity, snapshot_id, change_kind, count(*) AS n, array_to_string(list_sort(list(key))[1:10], '|') AS first_keys FROM k GROUP BY 1, 2, 3", "")
def history_changes(g):
    return I.changed_keys(p6_found(g.spark, g.root))


_INDEX = f"WITH s AS (SELECT {sql_key('id')} AS id, hash FROM unit_vectors QUALIFY row_number() OVER (PARTITION BY {sql_key('id')} ORDER BY built_at DESC, hash DESC) = 1), c AS (SELECT {sql_key('id')} AS id, source_hash AS hash FROM units QUALIFY row_number() OVER (PARTITION BY {sql_key('id')} ORDER BY updated_at DESC, source_hash DESC) = 1) "


@plan(_INDEX + "SELECT CASE WHEN c.id IS NULL THEN 'remove' WHEN s.hash = c.hash THEN 'reuse' ELSE 'encode' END AS status, count(*) AS n FROM s FULL JOIN c ON s.id = c.id GROUP BY 1", "")
def embed_incremental(g):
    last = lambda n, h, t: table(g.spark, g.root, n).groupBy(plain_key(F.col("id")).alias("id")).agg(F.max(F.struct(t, h)).alias("m")).select("id", F.col(f"m.{h}").alias("hash"))
    return I.refresh_plan(last("unit_vectors", "hash", "built_at"), last("units", "source_hash", "updated_at"))


@plan("SELECT fn_id, fn_name, intent FROM (SELECT fn_id, fn_name, upper(intent) AS intent FROM fn WHERE kind = 'method' UNION ALL SELECT fn_id, fn_name, intent FROM fn WHERE kind <> 'method') WHERE fn_id IN (SELECT target_fn FROM ed)")
def upsert_prune(g):
    f = g.functions("fn_name", "kind", "intent")
    base, change = f.select("fn_id", "fn_name", "intent"), f.where("kind = 'method'").select("fn_id", "fn_name", F.upper("intent").alias("intent"))
    return I.prune(I.upsert(base, change, "fn_id"), g.edges().select(F.col("target_fn").alias("fn_id")), "fn_id")


_SESS = """WITH r AS (SELECT lower(regexp_replace(session_id, '[\\s{}]+', '', 'g')) AS session_id, nullif(trim(uuid), '') AS uuid, lower(entry_type) AS kind, try_cast(ts AS TIMESTAMPTZ) AS t, CASE WHEN json_valid(message) THEN message END AS message, tool_use_result, received_at, cwd FROM transcript WHERE session_id IS NOT NULL),
e AS (SELECT * FROM r WHERE uuid IS NULL UNION ALL (SELECT * FROM r WHERE uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, uuid ORDER BY received_at DESC) = 1)),
tc AS (SELECT session_id, json_extract_string(b, '$.name') AS name, json_extract_string(b, '$.input.file_path') AS file_path, coalesce(json_extract_string(b, '$.input.command'), '') AS command,
 coalesce(try_cast(json_extract(message, '$.usage.input_tokens') AS BIGINT), 0) + coalesce(try_cast(json_extract(message, '$.usage.cache_read_input_tokens') AS BIGINT), 0) AS tokens_in, coalesce(try_cast(json_extract(message, '$.usage.output_tokens') AS BIGINT), 0) AS tokens_out
 FROM (SELECT session_id, message, unnest(CASE WHEN json_type(message, '$.content') = 'ARRAY' THEN json_extract(message, '$.content[*]') ELSE [] END) AS b FROM e WHERE kind = 'assistant') WHERE json_extract_string(b, '$.type') = 'tool_use'),
cl AS (SELECT *, CASE WHEN name IN ('Write', 'Edit', 'MultiEdit') THEN 'modification' WHEN name = 'Bash' AND regexp_matches(command, '\\b(pytest|py\\.test|npm\\s+test|cargo\\s+test|go\\s+test|dotnet\\s+test|jest|vitest|mocha)\\b') THEN 'verification' ELSE 'exploration' END AS class FROM tc) """


def _entries(g):
    return N.entries(table(g.spark, g.root, "transcript"))


@plan(_SESS + "SELECT name, count(*) AS calls, sum(tokens_in)::bigint AS tokens_in, sum(tokens_out)::bigint AS tokens_out, sum(tokens_in + tokens_out)::bigint AS total, (sum(tokens_in + tokens_out) // count(*))::bigint AS average FROM cl GROUP BY 1", "")
def tool_stats(g):
    return N.tool_stats(N.tool_calls(_entries(g)))


@plan(_SESS + "SELECT session_id, count(*) AS turns, count(*) FILTER (class = 'exploration') AS exploration, count(*) FILTER (class = 'modification') AS modification, count(*) FILTER (class = 'verification') AS verification FROM cl GROUP BY 1", "")
def session_turns(g):
    c = N.tool_calls(_entries(g))
    return c.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), *[F.count_if(F.col("class") == k).alias(k) for k in ("exploration", "modification", "verification")])


@plan(None)
def session_rollup(g):
    return N.rollup(_entries(g))


@plan(None)
def session_score(g):
    """Sessions scored by their commit, tests, end and corrections and by the newest debt figures of their project."""
    s, c = _sessions_commits(g)
    bound = N.bind_in_window(s.withColumn("started_at", F.date_trunc("day", "started_at")), c)
    undone = N.reverted_commits(c).select("commit_id", F.lit("reverted").alias("status")).distinct()
    status = bound.join(undone, "commit_id", "left").select("session_id", F.coalesce("status", F.lit("committed")).alias("status"))
    last = lambda d: d.groupBy("project").agg(F.max(F.struct("snapshot_id", *[x for x in d.columns if x not in STEP])).alias("m")).select("project", "m.*").drop("snapshot_id")
    debt = last(debt_delta(g).drop("functions_delta")).join(last(file_growth(g).drop("files_created")), "project", "full")
    rows = N.rollup(_entries(g)).join(s.select("session_id", "project"), "session_id", "left").join(status, "session_id", "left").fillna("uncommitted", ["status"]).join(debt, "project", "left")
    return N.score(rows)


def _sessions_commits(g):
    t = table(g.spark, g.root, "transcript").select(N.plain_session(F.col("session_id")).alias("session_id"), N.utc_millis(F.col("ts")).alias("t"), F.element_at(F.split(F.regexp_replace("cwd", r"\\", "/"), "/"), -1).alias("project")).where("session_id is not null")
    s = t.groupBy("session_id").agg(F.max("project").alias("project"), F.min("t").alias("started_at"), F.max("t").alias("completed_at")).where("started_at is not null")
    c = table(g.spark, g.root, "graph_files").select("project", F.explode("recent_commits").alias("c")).select("project", F.col("c.sha").alias("commit_id"), F.to_timestamp("c.commit_date").alias("at"), F.col("c.message").alias("message"), F.coalesce(F.col("c.message").contains(N.AUTO_COMMIT), F.lit(False)).alias("auto")).distinct()
    return s, c


_BIND = """WITH s AS (SELECT session_id, max(project) AS project, epoch(min(t))::bigint AS st, epoch(max(t))::bigint AS en FROM (SELECT lower(regexp_replace(session_id, '[\\s{}]+', '', 'g')) AS session_id, string_split(replace(cwd, '\\', '/'), '/')[-1] AS project, date_trunc('second', try_cast(ts AS TIMESTAMPTZ)) AS t FROM transcript WHERE session_id IS NOT NULL) GROUP BY 1 HAVING min(t) IS NOT NULL),
c AS (SELECT DISTINCT project, c.sha AS commit_id, epoch(c.commit_date::timestamp)::bigint AS tc, coalesce(contains(c.message, 'auto-commit'), false) AS auto FROM (SELECT project, unnest(recent_commits) AS c FROM graph_files)) """


# commits carry a day and no time, so a session starts with its day
@plan(_BIND + "SELECT session_id, commit_id FROM s JOIN c USING (project) WHERE tc BETWEEN st - st % 86400 - 60 AND en + 300 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY auto, tc DESC, commit_id DESC) = 1", "")
def session_commit_binding(g):
    s, c = _sessions_commits(g)
    return N.bind_in_window(s.withColumn("started_at", F.date_trunc("day", "started_at")), c)


@plan(_BIND + "SELECT commit_id, session_id, abs(tc - st) AS gap_s FROM (SELECT DISTINCT * FROM c) c JOIN s USING (project) WHERE abs(tc - st) < 43200 QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY abs(tc - st), session_id) = 1", "")
def nearest_session(g):
    s, c = _sessions_commits(g)
    return N.nearest_session(c, s, 43200)


def _events(g):
    return table(g.spark, g.root, "events")


@plan("SELECT event_id, user_id AS session, event_type AS path, props AS hash FROM events QUALIFY lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS DISTINCT FROM props OR lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NULL", "")
def debounce_events(g):
    e = _events(g).select(F.col("user_id").alias("session"), F.col("event_type").alias("path"), F.col("ts").alias("at"), "event_id", F.col("props").alias("hash"))
    return N.debounce(e).select("event_id", "session", "path", "hash")


@plan("SELECT user_id AS session, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS writes, count(*) FILTER (event_type = 'signup') AS checks, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'FAIL' WHEN count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'signup') = 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM events GROUP BY 1", "")
def session_verdict(g):
    kind = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "signup", "check").otherwise(F.col("event_type"))
    return N.verdict(_events(g).select(F.col("user_id").alias("session"), kind.alias("kind")))


@plan("""WITH RECURSIVE e AS (SELECT event_type || ':' || user_id AS unit, event_id AS call, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT unit, call, i, call AS seen, false AS suppressed FROM e WHERE i = 1 UNION ALL SELECT e.unit, e.call, e.i, CASE WHEN e.call + 1 - s.seen < 100 THEN s.seen ELSE e.call END, e.call + 1 - s.seen < 100 FROM s JOIN e ON e.unit = s.unit AND e.i = s.i + 1)
SELECT unit, call, suppressed FROM s""", "")
def seen_suppression(g):
    return N.suppress_seen(_events(g).select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("unit"), F.col("event_id").alias("call")), 100)


@plan("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY 1, 2", "")
def event_windows(g):
    return _events(g).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), T.round_half_up(F.sum("value"), 2).alias("total"))


@plan(None)
def insight_merge(g):
    e = _entries(g).where("kind = 'user'").select("session_id", "t", F.col("content").alias("description")).where(T.looks_like_correction(F.col("description")) & ~F.col("description").startswith("["))
    target = F.regexp_extract("description", r"([a-z]+)_", 1)
    return N.merge_insights(e.select(target.alias("target"), "description", F.concat_ws("|", "t", "session_id").alias("id"), F.lit(1).alias("turns")))


_HITS = """WITH u AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY trim(id) ORDER BY updated_at DESC, source_hash DESC) = 1), x AS (SELECT trim(id) AS unit_id, source_files[1] AS file, unnest(hardcoded_artifacts) AS a FROM u WHERE len(source_files) > 0),
h AS (SELECT unit_id, file, a.kind AS kind, coalesce(a.value, array_to_string(list_sort(a.value_list), ',')) AS value, coalesce(a.surface, '') AS surface FROM x),
hits AS (SELECT * FROM h WHERE value IS NOT NULL AND value NOT IN ('0', '1', '0.0', '1.0', '-1', 'True', 'False', 'None', 'null', '', 'id', 'name', 'type', 'value', 'key') AND NOT (regexp_full_match(value, '-?\\d+(\\.\\d+)?|-?\\.\\d+') AND surface = '')) """


def _units(g, with_hash: bool = False):
    """The row of each unit updated last; of equal times the larger hash."""
    u = table(g.spark, g.root, "units")
    cols = [c for c in u.columns if c not in ("id", "updated_at", "source_hash")]
    out = u.groupBy(F.trim("id").alias("id")).agg(F.max(F.struct("updated_at", "source_hash", *cols)).alias("r"))
    return out.select("id", *(["r.source_hash"] if with_hash else []), *[f"r.{c}" for c in cols])


@plan(_HITS + "SELECT value, count(*) AS hits, count(DISTINCT file) AS files, (SELECT kind FROM hits k WHERE k.value = hits.value GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) AS primary_kind, floor((SELECT count(*) FROM hits k WHERE k.value = hits.value GROUP BY kind ORDER BY count(*) DESC LIMIT 1)::double / count(*) * 100 + 0.5) / 100 AS kind_uniformity, left(sha256(value), 8) AS coupling_id FROM hits GROUP BY value HAVING count(*) >= 2 AND count(DISTINCT file) >= 2", "")
def couplings(g):
    return L.couplings(L.artifact_hits(_units(g)))


_LITS = ", lits AS (SELECT source_fn, target_fn, unnest(regexp_extract_all(expression, '\"([^\"]*)\"', 1)) AS literal FROM ed) "


@plan(_LITS + ", v AS (SELECT DISTINCT trim(id) AS unit_id, unnest(value_items) AS value FROM units WHERE kind = 'value_unit' QUALIFY row_number() OVER (PARTITION BY trim(id) ORDER BY updated_at DESC, source_hash DESC) = 1) SELECT unit_id, value, coalesce(uses, 0) AS uses FROM v LEFT JOIN (SELECT literal AS value, count(*) AS uses FROM lits GROUP BY 1) USING (value)")
def value_histogram(g):
    return L.value_histogram(_units(g), L.literal_uses(g.edges()))


@plan(_LITS + "SELECT literal, count(*) AS uses, count(DISTINCT source_fn) AS functions, count(DISTINCT split_part(source_fn, '::', 1)) AS files FROM lits GROUP BY 1")
def value_consumers(g):
    return L.value_consumers(L.literal_uses(g.edges()))


@plan("WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS content FROM (SELECT doc_id, string_split(replace(text, E'\\r\\n', E'\\n'), E'\\n') AS x FROM documents WHERE text IS NOT NULL)), w AS (SELECT doc_id, line, unnest(regexp_extract_all(content, '\\b(void|draft|sent)\\b')) AS value FROM l) SELECT value, doc_id, line, hits FROM (SELECT value, doc_id, line::int AS line, count(*) AS hits FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY value ORDER BY doc_id, line) <= 50", "")
def literal_occurrences(g):
    return L.literal_occurrences(table(g.spark, g.root, "documents"), ["void", "draft", "sent"])


@plan(", s AS (SELECT project, fn_id, line_count, sum(line_count) OVER (PARTITION BY project ORDER BY complexity DESC, fn_id ROWS UNBOUNDED PRECEDING) AS used FROM fn) SELECT project, fn_id, line_count, used::bigint AS used FROM s WHERE used <= 400")
def token_budget(g):
    f = g.functions("line_count", "complexity").select("project", "fn_id", "line_count", (-F.col("complexity")).alias("o"))
    return L.budgeted_prefix(f, "project", ["o", "fn_id"], "line_count", 400).drop("o")


@plan("SELECT doc_id, floor(length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g'))::double / length(text) * 10000 + 0.5) / 10000 AS share FROM documents WHERE length(text) > 0", "")
def cyrillic_ratio(g):
    return table(g.spark, g.root, "documents").where(F.length("text") > 0).select("doc_id", T.round_half_up(T.cyrillic_share(F.col("text")), 4).alias("share"))


@plan(f"SELECT u.id, CASE WHEN u.kind IN ('function_unit') THEN CASE WHEN fn.fn_id IS NULL THEN 'orphan' WHEN fn.docstring IS NULL THEN 'undocumented' ELSE 'documented' END ELSE 'other' END AS state FROM (SELECT {sql_key('id')} AS id, kind FROM units QUALIFY row_number() OVER (PARTITION BY trim(id) ORDER BY updated_at DESC, source_hash DESC) = 1) u LEFT JOIN fn ON fn.fn_id = u.id")
def unit_states(g):
    u = _units(g).select(plain_key(F.col("id")).alias("id"), "kind")
    f = g.functions("docstring").select(F.col("fn_id").alias("id"), F.lit(True).alias("live"), "docstring")
    state = F.when(F.col("kind") != "function_unit", "other").when(F.col("live").isNull(), "orphan").when(F.col("docstring").isNull(), "undocumented").otherwise("documented")
    return u.join(f, "id", "left").select("id", state.alias("state"))
