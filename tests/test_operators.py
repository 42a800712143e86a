"""Order-dependent and skewed operators against small brute-force versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.keys import plain_key, plain_session
from codeloom.operators import graph as G
from codeloom.operators import incremental as I
from codeloom.operators import sessions as N
from codeloom.operators.skew import hot_keys, lookup_join


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_plain_keys(spark):
    for s in ("a/b.py::f", "./a/b.py::f", "a//b.py::f", "a\\b.py::f", " a/b.py::f\t"):
        assert one(spark, s, plain_key) == "a/b.py::f"
    assert one(spark, "  ", plain_key) is None and one(spark, None, plain_key) is None
    assert one(spark, " {AB-1} ", plain_session) == "ab-1"


def test_names(spark):
    assert one(spark, "getHTTPResponse_v2", T.split_identifier) == ["get", "http", "response", "v2"]
    assert one(spark, None, T.split_identifier) == []
    assert one(spark, "Calculation of the prices", T.tokenize) == ["calcula", "pric"]
    assert one(spark, "x" * 200, lambda c: F.length(T.one_liner(c))) == 140


def test_hot_keys_and_lookup_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"V{i}") for i in range(200)], "k string, w string")
    hot = hot_keys(left, "k", 10)
    assert hot == ["hot"]
    assert lookup_join(left, right, "k", hot).count() == 1100
    assert lookup_join(left, right, "k", hot, "left").count() == 1201
    assert hot_keys(left.limit(0), "k") == []


def test_near_clone_names_lose_no_pair(spark):
    random.seed(1)
    words = ["get", "set", "load", "save", "price", "rate", "file", "tax", "row", "id"]
    names = sorted({"_".join(random.sample(words, random.randint(1, 5))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "fn_name string")
    sets = sorted({" ".join(sorted(set(n.split("_")))) for n in names})
    want = {(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :] if len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) >= 0.7}
    assert {(r.name_a, r.name_b) for r in G.near_clone_names(df).collect()} == want and want


def test_suppression_runs_along_a_unit(spark):
    calls = [1, 4, 9, 11, 12, 30]
    df = spark.createDataFrame([("u", c) for c in calls] + [(None, 1)], "unit string, call long")
    got = {r.call: r.suppressed for r in N.suppress_seen(df, 10).collect()}
    seen, want = None, {}
    for c in calls:
        want[c] = seen is not None and c + 1 - seen < 10
        seen = seen if want[c] else c
    assert got == want


def test_debounce_fires_again_after_a_change(spark):
    rows = [(1, "p", i, i, h) for i, h in enumerate("AABBA")] + [(1, "p", 9, 9, None)]
    df = spark.createDataFrame(rows, "session int, path string, at int, event_id int, hash string")
    assert sorted(r.event_id for r in N.debounce(df).collect()) == [0, 2, 4, 9]


def test_nearest_session_equals_brute_force(spark):
    random.seed(3)
    t0 = datetime(2026, 1, 1)
    s = [(f"s{i}", "p", t0 + timedelta(seconds=random.randrange(50000))) for i in range(40)]
    c = [(f"c{i}", "p", t0 + timedelta(seconds=random.randrange(50000))) for i in range(40)]
    got = {r.commit_id: (r.session_id, r.gap_s) for r in N.nearest_session(spark.createDataFrame(c, "commit_id string, project string, at timestamp"), spark.createDataFrame(s, "session_id string, project string, started_at timestamp"), 1800).collect()}
    want = {}
    for ci, _, at in c:
        gap, sid = min((abs(int((at - st).total_seconds())), si) for si, _, st in s)
        if gap < 1800:
            want[ci] = (sid, gap)
    assert got == want


def test_degrees_add_up_and_mutual_imports(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "source_fn string, target_fn string")
    assert sum(r.degree for r in G.degree_centrality(e).collect()) == 6
    im = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "z"), ("x", "y")], "source_file string, target_file string")
    assert [tuple(r) for r in G.mutual_imports(im).collect()] == [("x", "y")]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    change = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = I.upsert(base, change, "id")
    assert sorted(map(tuple, I.upsert(once, change, "id").collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_insights_merge_alike_texts(spark):
    rows = [("t", "the price is rounded twice here", "1", 2), ("t", "the price is rounded twice there", "2", 3), ("t", "something else", "3", 1), ("u", "the price is rounded twice here", "4", 1), (None, "x", "5", 1), ("t", None, "6", 1)]
    got = {(r.target, r.occurrences, r.turns, r.priority) for r in N.merge_insights(spark.createDataFrame(rows, "target string, description string, id string, turns int")).collect()}
    assert got == {("t", 2, 5, "medium"), ("t", 1, 1, "low"), ("u", 1, 1, "low")}


def test_scratch_tables_can_be_cleared(spark):
    import os

    from codeloom.runtime import Scratch, clear_scratch

    tmp = Scratch(spark, "t")
    assert tmp.save(spark.range(5)).count() == 5
    where = tmp.root.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(where)
    clear_scratch(spark)
    assert not os.path.exists(where)


def test_every_query_vector_is_searched_in_blocks(spark, monkeypatch):
    from codeloom.operators import search

    monkeypatch.setattr(search, "ROWS", 30)
    monkeypatch.setattr(search, "QUERIES", 3)
    rows = [(i, [float((i * j) % 7) for j in range(1, 5)]) for i in range(200)] + [(None, [1.0] * 4), (500, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    top = search.vector_topk_each(v, v.where("vec_id % 20 = 0"))
    got = {(r.query_id, r.vec_id, r.score) for r in top.collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    want = {(q, i, s) for q, x in rows[:200:20] for s, i in sorted(((dot(x, y), i) for i, y in rows[:200] if i != q), key=lambda t: (-t[0], t[1]))[:5]}
    assert got == want and len(got) == 50
    assert search.vector_verdict(top, "query_id").count() == 10


def test_clones_share_a_class(spark):
    f = spark.createDataFrame([("b", "h"), ("a", "h"), ("c", "x"), ("d", None), ("e", None)], "fn_id string, ast_hash string")
    assert {tuple(r) for r in G.exact_clones(f).collect()} == {("a", "a", 1), ("b", "a", 1)}


def test_scratch_tables_that_a_result_does_not_read_are_given_up(spark):
    import os

    from codeloom.runtime import Scratch

    tmp = Scratch(spark, "t")
    tmp.save(spark.range(5), "a")
    kept = tmp.save(spark.range(6), "b")
    tmp.keep_only("b")
    assert kept.count() == 6 and [d.split("_")[1] for d in os.listdir(tmp.root.removeprefix("file://").removeprefix("file:"))] == ["b"]


def test_task_lint(spark):
    from codeloom.operators import rules as R

    df = spark.createDataFrame([("fix it", 0.9), ("add the price and remove the cache", 0.9), ("tidy up the price loader", 0.2), (None, None)], "c string, s double")
    assert [r.x for r in df.select(R.task_lint(F.col("c"), F.col("s")).alias("x")).collect()] == [["short"], ["several"], ["unclear"], ["short"]]


def test_callers_that_may_be_reused(spark):
    from codeloom.operators import search as S

    f = spark.createDataFrame([("a", []), ("b", [("ticketPrice", None, None)]), ("c", [("x", None, None)])], "fn_id string, params array<struct<name:string,type_hint:string,default_value:string>>")
    e = spark.createDataFrame([("b", "a"), ("c", "a")], "source_fn string, target_fn string")
    assert [tuple(r) for r in S.reuse_suggestions(f.where("fn_id = 'a'"), f, e, "sum the ticket prices").collect()] == [("a", "b", "ticket")]
