"""Rules, lints and messages."""

from pyspark.sql import functions as F

from codeloom.operators import rules as R
from codeloom.operators import upkeep as U

RULES = "id int, category string, title string, content string, source string, affects array<string>"


def make(spark):
    return spark.createDataFrame([(1, "a", "t1", "Keep it. More.", "auto", ["core", "x/y.py"]), (2, "a", "t2", "Manual one.", "manual", None), (3, "b", "t3", "Third", "auto", [])], RULES)


def test_lookup_and_coherence(spark):
    r = make(spark)
    assert [x.id for x in R.rules_for(r, zone="cor").collect()] == [1]
    assert [x.id for x in R.rules_for(r, file="p/x/y.py").collect()] == [1]
    assert R.rules_for(r).count() == 0
    files = spark.createDataFrame([("p/x/y.py",), ("z.py",), (None,)], "path string")
    assert [tuple(x) for x in R.coherence(files, r).collect()] == [("p/x/y.py", 1)]


def test_audit_spares_manual_rules(spark):
    r = make(spark)
    add = spark.createDataFrame([(0, "c", "new", "N", "auto", None)], RULES)
    got = R.apply_audit(r, add, spark.createDataFrame([(3, None, "t3x", " ", None, None)], RULES), r.where("id in (1, 2)"))
    assert {(x.id, x.title, x.content) for x in got.collect()} == {(2, "t2", "Manual one."), (3, "t3x", "Third"), (4, "new", "N")}
    assert {(x.category, x.id, x.summary) for x in U.one_per_category(r).collect()} == {("a", 2, "Manual one"), ("b", 3, "Third")}


def test_texts(spark):
    rows = spark.createDataFrame([("feat(AB-12): add the tax",), ("add the tax AB-12",), ("fix: the tax",), (None,)], "c string")
    assert [x[0] for x in rows.select(R.commit_message(F.col("c"))).collect()] == ["AB-12: add the tax", "AB-12: add the tax", "the tax", None]
    assert [x[0] for x in spark.createDataFrame([("fix",), ("add a tax and rename the seat",), ("split the big module",), (None,)], "c string").select(R.task_lint(F.col("c"))).collect()] == [["short"], ["several"], [], ["short"]]
    rep = spark.createDataFrame([("HIGH", 1.7, "x" * 600), ("odd", float("nan"), None)], "risk_level string, risk_score double, summary string")
    assert [(x.risk_level, x.risk_score, len(x.summary or "")) for x in R.clean_report(rep).collect()] == [("high", 1.0, 500), ("medium", 0.0, 0)]


def test_greedy_budget_and_redo(spark):
    s = spark.createDataFrame([([("a", 5), ("b", 9), ("c", 4)],), ([],)], "s array<struct<name:string,tokens:long>>")
    assert [x[0] for x in s.select(U.greedy_budget(F.col("s"), 10)).collect()] == [["a", "c"], []]
    t = spark.createDataFrame([("s1", "h", 1), ("s2", "h", 2), ("s3", "h", 3), ("s4", None, 4)], "session_id string, task_hash string, started_at int")
    assert {tuple(x) for x in U.redone_tasks(t).collect()} == {("s2", "s1"), ("s3", "s2")}


def test_encoder(spark):
    rows = spark.createDataFrame([("1", "tax rate"), ("2", "rate tax"), ("3", None)], "id string, text string")
    v = {x.id: list(x.vec) for x in R.encode(rows, R.hash_encoder(16)).collect()}
    assert v["1"] == v["2"] and abs(sum(x * x for x in v["1"]) - 1) < 1e-5 and sum(map(abs, v["3"])) == 0
