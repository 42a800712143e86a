"""Projection, lint and encoding queries, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import rules as R
from codeloom.plans.graph_plans import CALLERS
from codeloom.plans.views import BASE, Graph
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


@plan(CALLERS + "SELECT fn_id, fn_name, callers, callers > 0 AS locked FROM wc JOIN fl ON fl.path = wc.file WHERE zone_name = 'core'")
def projection_nodes(g):
    return R.graph_projection(g.functions("fn_name"), g.edges(), g.files("zone_name"), "core")[0]


@plan(", z AS (SELECT fn_id FROM fn JOIN fl ON fl.path = fn.file WHERE zone_name = 'core') SELECT DISTINCT source_fn, target_fn FROM ed WHERE source_fn IN (SELECT fn_id FROM z) AND target_fn IN (SELECT fn_id FROM z)")
def projection_links(g):
    return R.graph_projection(g.functions("fn_name"), g.edges(), g.files("zone_name"), "core")[1]


@plan("SELECT project, count(DISTINCT session_id) AS sessions, count(*) AS n FROM (SELECT lower(regexp_replace(session_id, '[\\s{}]+', '', 'g')) AS session_id, lower(string_split(replace(cwd, '\\', '/'), '/')[-1]) AS project FROM transcript WHERE session_id IS NOT NULL AND cwd IS NOT NULL) GROUP BY 1", "")
def project_sessions(g):
    t = table(g.spark, g.root, "transcript").where("session_id is not null and cwd is not null")
    from codeloom.functions.keys import plain_session

    t = t.select(plain_session(F.col("session_id")).alias("session_id"), F.lower(F.element_at(F.split(F.regexp_replace("cwd", r"\\", "/"), "/"), -1)).alias("project"))
    return t.groupBy("project").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("n"))


@plan("SELECT doc_id, CASE WHEN len(list_filter(string_split_regex(trim(coalesce(title, '')), '\\s+'), lambda w: w <> '')) < 3 THEN 'short' ELSE '' END AS lint FROM documents", "")
def title_lint(g):
    return table(g.spark, g.root, "documents").select("doc_id", F.array_join(R.task_lint(F.col("title")), ",").alias("lint"))


@plan(None)
def encoded_units(g):
    u = table(g.spark, g.root, "units").select(F.concat_ws("@", "id", F.col("updated_at").cast("string")).alias("id"), F.concat_ws("\n\n", "unit_name", "summary", "description").alias("text"))
    return R.encode(u, R.hash_encoder())


@plan("SELECT session, count(*) AS runs, max(n) AS longest FROM (SELECT session, run, count(*) AS n FROM (SELECT user_id AS session, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1", "")
def event_sessions(g):
    e = table(g.spark, g.root, "events").select(F.col("user_id").alias("session"), F.session_window("ts", "30 minutes 1 microsecond").alias("w"))
    n = e.groupBy("session", "w").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("session").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))
