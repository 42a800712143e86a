"""Snapshot differences on hand-made states."""

from datetime import datetime

from pyspark.sql import functions as F

from codeloom.operators.snapshots import delivery_calendar, graph_states, snapshot_changes

STATE = "entity string, project string, snapshot_id int, key_a string, key_b string, loaded_at timestamp, content long"


def t(n):
    return datetime(2026, 1, 1, n)


def diff(spark, rows, deliveries):
    cal = delivery_calendar(spark.createDataFrame(deliveries, "project string, snapshot_id int"))
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, STATE), cal).collect()}


def test_added_removed_changed(spark):
    rows = [("f", "p", 1, "a", "", t(1), 1), ("f", "p", 1, "b", "", t(1), 1), ("f", "p", 1, "c", "", t(1), 1), ("f", "p", 2, "a", "", t(1), 1), ("f", "p", 2, "b", "", t(1), 2), ("f", "p", 2, "d", "", t(1), 1)]
    assert diff(spark, rows, [("p", 1), ("p", 2)]) == {("f", 2, "b", "", "changed"), ("f", 2, "c", "", "removed"), ("f", 2, "d", "", "added")}


def test_latest_delivery_counts_and_order_of_rows_does_not_matter(spark):
    rows = [("f", "p", 1, "a", "", t(1), 1), ("f", "p", 2, "a", "", t(5), 1), ("f", "p", 2, "a", "", t(2), 9), ("f", "p", 2, "a", "", t(5), 1)]
    assert diff(spark, rows, [("p", 1), ("p", 2)]) == set()
    assert diff(spark, rows[::-1], [("p", 1), ("p", 2)]) == set()


def test_gap_in_deliveries_compares_with_the_previous_delivered(spark):
    rows = [("f", "p", 1, "a", "", t(1), 1), ("f", "p", 3, "a", "", t(1), 2), ("f", "q", 2, "x", "", t(1), 1), ("f", "q", 3, "x", "", t(1), 1)]
    assert diff(spark, rows, [("p", 1), ("p", 3), ("q", 2), ("q", 3)]) == {("f", 3, "a", "", "changed")}


def test_first_snapshot_and_undelivered_rows_give_nothing(spark):
    rows = [("f", "p", 1, "a", "", t(1), 1), ("f", "p", 2, "b", "", t(1), 1)]
    assert diff(spark, rows, [("p", 1)]) == set()
    assert diff(spark, [], []) == set()


FN = "snapshot_id int, loaded_at timestamp, project string, id string, file string, fn_name string, kind string, prog_lang string, line_start int, line_end int, params array<struct<name:string,type_hint:string,default_value:string>>, return_type string, is_async boolean, docstring string, complexity int, line_count int, route string, http_method string, template string, ast_hash string, intent string, text_lang string, secondary_intents array<string>, class_name string, extra string"


def write_tables(spark, folder, fns, edges=(), files=()):
    spark.createDataFrame(fns, FN).write.mode("overwrite").parquet(f"{folder}/graph_functions.parquet")
    spark.createDataFrame(list(edges), "snapshot_id int, loaded_at timestamp, project string, source_fn string, target_fn string, site_file string, line int, expression string, confidence double").write.mode("overwrite").parquet(f"{folder}/graph_call_edges.parquet")
    spark.createDataFrame(list(files), "snapshot_id int, loaded_at timestamp, project string, path string, prog_lang string, imports array<struct<capture:string,text:string>>, function_ids array<string>, lines_of_code int, zone_name string, source_hash string").write.mode("overwrite").parquet(f"{folder}/graph_files.parquet")


def fn(snapshot, ident, **kw):
    base = dict(fn_name="f", kind="function", prog_lang="python", line_start=1, line_end=2, params=[("a", None, None)], return_type=None, is_async=False, docstring=None, complexity=1, line_count=2, route=None, http_method=None, template=None, ast_hash="h", intent="x", text_lang="en", secondary_intents=["b", "a"], class_name=None, extra="ignored")
    base.update(kw)
    order = ["fn_name", "kind", "prog_lang", "line_start", "line_end", "params", "return_type", "is_async", "docstring", "complexity", "line_count", "route", "http_method", "template", "ast_hash", "intent", "text_lang", "secondary_intents", "class_name", "extra"]
    return (snapshot, t(1), "p", ident, "p/x.py", *[base[c] for c in order])


def test_spellings_blanks_orders_and_lines_are_no_change(spark, tmp_path):
    fns = [fn(1, "p/x.py::f"), fn(2, "./p\\x.py::f ", line_start=9, docstring=" ", return_type="", secondary_intents=["a", "b"], params=[("a", "", None)])]
    write_tables(spark, str(tmp_path), fns, [(1, t(1), "p", "a", "b", "s", 3, "b()", 0.95), (2, t(1), "p", "a", "./b", "./s", 4, " b()", 0.9499999)], [(1, t(1), "p", "p/x.py", "python", None, [], 1, "z", "h"), (2, t(1), "p", "p//x.py", "python", [], None, 1, "z", "h")])
    states = graph_states(spark, str(tmp_path))
    cal = delivery_calendar(spark.read.parquet(f"{tmp_path}/graph_files.parquet"))
    assert snapshot_changes(states, cal).count() == 0


def test_null_number_and_neighbouring_columns_do_not_cancel(spark, tmp_path):
    fns = [fn(1, "p/x.py::f", complexity=None, line_count=5), fn(2, "p/x.py::f", complexity=5, line_count=None)]
    write_tables(spark, str(tmp_path), fns, [], [(1, t(1), "p", "p/x.py", "python", [], [], 1, "z", "h"), (2, t(1), "p", "p/x.py", "python", [], [], 1, "z", "h")])
    cal = delivery_calendar(spark.read.parquet(f"{tmp_path}/graph_files.parquet"))
    got = snapshot_changes(graph_states(spark, str(tmp_path)), cal).select("key_a", "change_kind").collect()
    assert [tuple(r) for r in got] == [("p/x.py::f", "changed")]
    assert graph_states(spark, str(tmp_path)).where(F.col("content").isNull()).count() == 0


def test_differences_take_the_previous_delivered_snapshot(spark, data):
    from codeloom.plans.catalogue import QUERIES

    moved = {tuple(r) for r in QUERIES["p6_found"](spark, data).where("change_kind in ('added', 'removed')").select("entity", "snapshot_id", "key_a", "change_kind").collect()}
    f = {("functions", r.snapshot_id, r.fn_id, r.change) for r in QUERIES["signature_diff"](spark, data).where("change <> 'changed'").collect()}
    p = {("files", r.snapshot_id, r.path, {"new": "added"}.get(r.status, r.status)) for r in QUERIES["changed_files"](spark, data).where("status in ('new', 'removed')").collect()}
    assert f | p == {r for r in moved if r[0] != "call_edges"} and len({r[1] for r in f}) > 1
    gained = {}
    for _, s, _, kind in f:
        gained[s] = gained.get(s, 0) + (1 if kind == "added" else -1)
    got = {r.snapshot_id: r.d for r in QUERIES["debt_delta"](spark, data).groupBy("snapshot_id").agg({"functions_delta": "sum"}).withColumnRenamed("sum(functions_delta)", "d").collect()}
    assert {s: d for s, d in got.items() if d} == {s: d for s, d in gained.items() if d}
    assert all({"snapshot_id"} <= set(QUERIES[n](spark, data).columns) for n in ("value_diff", "incremental_update", "audit_packet"))
    assert QUERIES["audit_packet"](spark, data).groupBy("snapshot_id").count().where("count > 30").isEmpty() and QUERIES["value_diff"](spark, data).select("snapshot_id").distinct().count() > 1
    assert QUERIES["incremental_update"](spark, data).groupBy("project", "snapshot_id", "fn_id").count().where("count > 1").isEmpty()


def test_one_key_in_two_projects(spark):
    rows = [("f", "p", 1, "a", "", t(1), 1), ("f", "p", 2, "b", "", t(1), 1), ("f", "q", 1, "b", "", t(1), 1), ("f", "q", 2, "a", "", t(1), 1)]
    cal = delivery_calendar(spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), ("q", 2)], "project string, snapshot_id int"))
    got = [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, STATE), cal).collect()]
    assert sorted(got) == [("f", 2, "a", "", "added"), ("f", 2, "a", "", "removed"), ("f", 2, "b", "", "added"), ("f", 2, "b", "", "removed")]


def test_history_counts_repeats_once_and_skips_missing_projects(spark, tmp_path):
    from codeloom.plans.catalogue import QUERIES

    late = lambda row, got: (row[0], t(got), *row[2:])
    fns = [fn(1, "p/x.py::f", complexity=4), fn(1, "p/x.py::g"), fn(2, "p/x.py::f", complexity=4), late(fn(2, "./p/x.py::f", complexity=7), 9), fn(3, "p/x.py::f", complexity=7)]
    edge = lambda s: (s, t(1), "p", "p/x.py::f", "p/x.py::g", "p/x.py", 3, "g()", 0.9)
    file = lambda s, p="p": (s, t(1), p, f"{p}/x.py", "python", [], [], 1, "z", "h")
    write_tables(spark, str(tmp_path), fns, [edge(1), edge(2), edge(2)], [file(1), file(2), file(2), file(3), file(1, "q"), file(3, "q")])
    got = {r.snapshot_id: r for r in QUERIES["snapshot_history"](spark, str(tmp_path)).collect()}
    assert [(got[s].n_projects, got[s].n_functions, got[s].complexity, got[s].n_edges, got[s].n_files) for s in (1, 2, 3)][1] == (1, 1, 7, 1, 1)
    assert (got[2].d_n_functions, got[2].d_n_files, got[3].d_n_files, got[3].d_n_edges) == (-1, 0, 0, -1)
    calls = {(r.snapshot_id, r.fn_id): (r.change, r.callers) for r in QUERIES["signature_diff"](spark, str(tmp_path)).collect()}
    assert calls == {(2, "p/x.py::g"): ("removed", 1)}
