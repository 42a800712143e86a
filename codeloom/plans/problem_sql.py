"""SQL with the same rows as the problem queries that SQL can express on whole tables."""

from __future__ import annotations

from codeloom.plans.views import sql_key


def _t(c: str) -> str:
    return f"coalesce(regexp_replace({c}::varchar, '^[\\s]+|[\\s]+$', '', 'g'), '')"


def _structs(c: str, *fields: str) -> str:
    return f"list_transform(coalesce({c}, []), lambda x: " + " || chr(2) || ".join(_t(f"x.{f}") for f in fields) + ")"


def _state(entity: str, table: str, a: str, b: str, parts: list[str]) -> str:
    content = " || chr(1) || ".join(parts)
    return f"SELECT '{entity}' AS entity, project, snapshot_id, {a} AS key_a, {b} AS key_b, {content} AS content FROM {table} QUALIFY row_number() OVER (PARTITION BY project, snapshot_id, {a}, {b} ORDER BY loaded_at DESC) = 1"


_FN = [_t(c) for c in ("fn_name", "kind", "prog_lang", "return_type", "docstring", "route", "http_method", "template", "ast_hash", "intent", "text_lang", "class_name", "is_async", "complexity", "line_count")]
_FN += [f"array_to_string({_structs('params', 'name', 'type_hint', 'default_value')}, chr(3))", "array_to_string(list_sort(list_transform(coalesce(secondary_intents, []), lambda x: trim(x))), chr(3))"]
_ED = [f"coalesce({sql_key('site_file')}, '')", _t("expression"), "(floor(confidence * 100 + 0.5) / 100)::varchar"]
_FL = [_t(c) for c in ("prog_lang", "zone_name", "source_hash", "lines_of_code")]
_FL += [f"array_to_string(list_sort({_structs('imports', 'capture', 'text')}), chr(3))", f"array_to_string(list_sort(list_transform(coalesce(function_ids, []), lambda x: {sql_key('x')})), chr(3))"]

P6 = f"""WITH st AS ({_state("functions", "graph_functions", sql_key("id"), "''", _FN)} UNION ALL ({_state("call_edges", "graph_call_edges", sql_key("source_fn"), sql_key("target_fn"), _ED)}) UNION ALL ({_state("files", "graph_files", sql_key("path"), "''", _FL)})),
cal AS (SELECT project, snapshot_id, lag(snapshot_id) OVER (PARTITION BY project ORDER BY snapshot_id) AS prev_id, lead(snapshot_id) OVER (PARTITION BY project ORDER BY snapshot_id) AS next_id FROM (SELECT DISTINCT project, snapshot_id FROM graph_files)),
cur AS (SELECT entity, snapshot_id, key_a, key_b, content FROM st JOIN cal USING (project, snapshot_id) WHERE prev_id IS NOT NULL),
pre AS (SELECT entity, next_id AS snapshot_id, key_a, key_b, content FROM st JOIN cal USING (project, snapshot_id) WHERE next_id IS NOT NULL),
new AS (SELECT * FROM cur EXCEPT ALL SELECT * FROM pre), old AS (SELECT * FROM pre EXCEPT ALL SELECT * FROM cur)
SELECT entity, snapshot_id, key_a, key_b, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed' ELSE 'changed' END AS change_kind FROM new n FULL JOIN old o USING (entity, snapshot_id, key_a, key_b)"""

ORACLES = {"p6_found": P6}
