"""Nested records as flat tables."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.operators.nested import child_tables, label_nodes, read_payload, record_nodes


def children(spark, rows):
    df = spark.createDataFrame(rows, "record_id string, payload string, received_at int, record_kind string")
    return {tuple(r) for r in child_tables(record_nodes(df)).collect()}


def test_every_kind_of_child(spark):
    rec = {"path": "./a/b.py", "imports": {"capture": "m", "text": "x"}, "functions": {"a/b.py::f": {"params": ["p", None, {"name": "q"}], "impact": {"callerClassifications": json.dumps([{"caller": "c"}]), "hardcoded_artifacts": [None, {"value": ["u", "v"]}, {"value": "w"}]}}}}
    got = children(spark, [("r", "Here it is:\n```json\n" + json.dumps(rec) + "\n```", 1, None)])
    f = "a/b.py::f"
    assert got == {("r", "imports", "a/b.py", 0, -1), ("r", "params", f, 0, -1), ("r", "params", f, 2, -1), ("r", "caller_classifications", f, 0, -1), ("r", "hardcoded_artifacts", f, 1, -1), ("r", "hardcoded_artifacts", f, 2, -1), ("r", "artifact_values", f, 1, 0), ("r", "artifact_values", f, 1, 1)}


def test_last_received_holds_and_bad_payloads_give_nothing(spark):
    good, old = json.dumps({"id": "a::f", "params": [{"name": "x"}]}), json.dumps({"id": "a::f", "params": [{"name": "x"}, {"name": "y"}]})
    rows = [("r", old, 1, "function"), ("r", good, 2, "function"), ("s", good[:-5], 1, None), ("t", "no record", 1, None), ("u", "", 1, None), ("v", None, 1, None), (None, good, 1, None)]
    assert children(spark, rows) == {("r", "params", "a::f", 0, -1)}
    assert children(spark, []) == set()


def test_wrapping():
    rec = {"id": "x", "params": []}
    for text in (json.dumps(rec), json.dumps(json.dumps(rec)), "note {see below}: " + json.dumps(rec), "\ufeff" + json.dumps([rec]), json.dumps({"data": rec})):
        assert read_payload(text) == rec
    assert read_payload('{"id": "x", "params": [{"name": "a"}') is None


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["params", "functions", "impact", "value", "x", "hardcoded_artifacts"]), c, max_size=3), max_leaves=12))
def test_intervals_nest_or_are_apart(value):
    spans = [(pre, post) for _, pre, post, *_ in label_nodes({"id": "r", "functions": value})]
    for a in spans:
        for b in spans:
            assert a == b or a[1] < b[0] or b[1] < a[0] or (a[0] < b[0] and b[1] < a[1]) or (b[0] < a[0] and a[1] < b[1])


def test_a_brace_in_a_remark_hides_no_record():
    from codeloom.operators.nested import read_payload

    assert read_payload('note { x: {"id":"a::b","params":[{"name":"p"}]}')["id"] == "a::b"
    assert read_payload('{"id": "a::b", "params": [{"name": "p"}, {"na') is None
    assert read_payload("no object { at all") is None
