"""All queries of the core library and the SQL that gives the same rows."""

from __future__ import annotations

from codeloom.operators.nested import p7_found
from codeloom.operators.snapshots import p6_found
from codeloom.plans import extra_plans, graph_plans, more_plans, problem_sql, rule_plans, source_plans, tool_plans, upkeep_plans

QUERIES: dict = {"p6_found": p6_found, "p7_found": p7_found, **graph_plans.QUERIES, **more_plans.QUERIES, **source_plans.QUERIES, **upkeep_plans.QUERIES, **tool_plans.QUERIES, **extra_plans.QUERIES, **rule_plans.QUERIES}
ORACLES: dict[str, str] = {**graph_plans.ORACLES, **more_plans.ORACLES, **problem_sql.ORACLES, **source_plans.ORACLES, **upkeep_plans.ORACLES, **tool_plans.ORACLES, **extra_plans.ORACLES, **rule_plans.ORACLES}
