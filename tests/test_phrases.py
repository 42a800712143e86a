"""Phrases, detectors, records and targets on hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.functions import phrases as P
from codeloom.operators import detect as D
from codeloom.operators import records as C
from codeloom.operators import sessions as N
from codeloom.operators import targets as R
from codeloom.operators import tools
from codeloom.operators.ordering import numbered, running_sum


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: P.clip(F.lit("abcdefgh"), 6), "abc..."), (lambda: P.clean_intent(F.lit(' "Sorts rows. Then more." ')), "Sorts rows."), (lambda: P.clean_intent(F.lit(None)), ""),
        (lambda: P.creation_intent(F.lit("Please ADD a small function")), True), (lambda: P.creation_intent(F.lit("add\nfunction")), False), (lambda: P.intent_words(F.lit("Could you please add x")), "add x"),
        (lambda: P.call_literals(F.lit("""f("a", 'b', 3, x1, -7, "1")""")), ["a", "b", "1", "3", "-7"]), (lambda: P.call_literals(F.lit(None)), []),
        (lambda: P.canonical_value(F.lit(None).cast("string"), F.array(F.lit("b"), F.lit("a"))), '["a","b"]'),
        (lambda: P.fallback_message(F.array(*[F.lit(f"d/f{i}.py") for i in range(6)]), F.array(F.lit("g"))), "wip: f0.py, f1.py, f2.py, f3.py (+2 more) | g"),
        (lambda: P.fallback_message(F.array().cast("array<string>"), F.array().cast("array<string>")), "wip: changes"),
        (lambda: P.head_and_tail(F.array(*[F.lit(str(i)) for i in range(6)]), 4), "0\n1\n...\n4\n5"), (lambda: P.source_lines(F.lit("a\r\nb\nc"), F.lit(2), F.lit(9)), ["b", "c"]),
        (lambda: P.include_list(F.lit('["map", "rules"]')), ["map", "rules"]), (lambda: P.include_list(F.lit("map, rules")), ["map", "rules"]), (lambda: P.include_list(F.lit(None)), []),
        (lambda: P.repaired(F.lit("привет".encode().decode("cp1251"))), "привет"), (lambda: P.repaired(F.lit("привет мир")), "привет мир"), (lambda: P.repaired(F.lit("plain")), "plain"),
        (lambda: P.version_numbers(F.lit("1.10.2")), [1, 10, 2]), (lambda: P.version_numbers(F.lit("1.x")), [0]), (lambda: P.safe_name(F.lit("a/../b")), "a___b"), (lambda: P.safe_name(F.lit("")), "unknown"),
        (lambda: F.to_json(P.hunk_lines(F.lit("+++ b/a.py\n@@ -1,2 +3,2 @@ x\n@@ -9 +9 @@\n@@ -9,3 +12,0 @@\n"))), '[{"file":"a.py","first":3,"n":2},{"file":"a.py","first":9,"n":1}]'),
        (lambda: F.to_json(P.numstat(F.lit("3\t1\ta.py\n-\t-\tb.png\nnoise\n"))), '[{"file":"a.py","added":3,"removed":1},{"file":"b.png","added":0,"removed":0}]'),
        (lambda: P.attribute_summary(F.lit("x"), F.lit("Field"), F.lit("int")), "x — Field; annotation: int."),
    ],
)
def test_phrases(spark, column, want):
    assert one(spark, column()) == want


def test_zones_pass_through_chains(spark):
    paths = ["p/src/app/core/a.py", "p/src/app/web/b.py", "p/src/app/c.py", "p/tool.py", "p/docs/d.py", "p/docs/e/f.py"]
    f = spark.createDataFrame([(x, "p") for x in paths], "path string, project string")
    assert {r.path: r.zone for r in D.zones(f).collect()} == dict(zip(paths, ["core", "web", "core", "tool", "docs", "docs"]))
    assert D.zones(f.limit(0)).count() == 0


def test_detectors(spark):
    py = ["import lib\n@dec\nclass A(Base): pass\n@dec()\ndef f(): return 1, 2\ndef g():\n    return 1, 2\n", "import lib\nclass B(Base): pass\n@dec\ndef h(): pass\n", "from lib import x\nclass C(Base): pass\nimport pytest\n@pytest.fixture\ndef a(): pass\n@pytest.fixture\ndef b(): pass\n", "x = 1\n"]
    files = spark.createDataFrame([(f"p/{n}.py", "p", "python", t) for n, t in zip(["a", "b", "c", "lib"], py)] + [("p/e.py", "p", "python", None)], "path string, project string, prog_lang string, content string")
    got = {(r.detector, r.title, r.n) for r in D.detected_rules(files).collect()}
    assert got == {("base_classes", "Base", 3), ("error_handlers", "p/a.py", 2), ("decorators", "dec", 2), ("fixtures", "p/c.py", 2), ("popular_modules", "lib", 3)}


def test_collections_of_values(spark):
    c = spark.createDataFrame([("m.py", "STATES")], "path string, name string")
    bodies = spark.createDataFrame([("m.py::a", "m.py", "if x in STATES"), ("n.py::b", "n.py", "STATES"), ("o.py::c", "o.py", "STATES"), ("q.py::d", "q.py", "STATES_OLD"), ("r.py::e", "r.py", "STATES")], "fn_id string, file string, body string")
    im = spark.createDataFrame([("n.py", "m.py", ["STATES"]), ("o.py", "m.py", ["other"]), ("q.py", "m.py", [])], "source_file string, target_file string, names array<string>")
    assert {r.fn_id for r in D.referencing_functions(c, bodies, im).collect()} == {"m.py::a", "n.py::b"}
    v = "path string, name string, values array<string>"
    before, after = spark.createDataFrame([("m", "S", ["a", "b"]), ("m", "gone", ["z"])], v), spark.createDataFrame([("m", "S", ["b", "c"])], v)
    uses = spark.createDataFrame([("m", "S", "a", "x.py::f"), ("m", "S", "a", "y.py::g"), ("m", "S", "b", "x.py::f")], "path string, name string, value string, fn_id string")
    assert [tuple(r) for r in D.value_changes(before, after, uses).collect()] == [("m", "S", "c", "a", 2, 2)]
    removed, hits = spark.createDataFrame([("S", "a"), ("S", "q")], "name string, value string"), spark.createDataFrame([("q", 3)], "value string, hits long")
    n = spark.createDataFrame([("a", 2)], "value string, uses long")
    assert {(r.value, r.severity) for r in tools.value_warnings(removed, n, hits).collect()} == {("a", "error"), ("q", "warning")}
    assert {r.severity for r in tools.value_warnings(removed, n, hits, hook=True).collect()} == {"error"}


def test_templates_by_tier(spark):
    h = D.rendered_templates(spark.createDataFrame([("1", "web/a.py", 'return render_template("x.html")'), ("2", "web/shop/b.py", "render_template('y.html', a=1)"), ("3", "c.py", "return 1"), ("4", "d.py", "render_template('z.html')")], "fn_id string, file string, body string"))
    t = spark.createDataFrame([("templates/x.html",), ("web/shop/t/y.html",), ("web/t/y.html",), ("z.html",)], "path string")
    assert {(r.fn_id, r.path, r.tier) for r in D.template_files(h, t).collect()} == {("1", "templates/x.html", 2), ("2", "web/shop/t/y.html", 3), ("4", "z.html", 1)}


def test_explicit_and_fuzzy_targets(spark):
    files = spark.createDataFrame([("p/mod/price.py", "p", "modz"), ("p/tests/test_a.py", "p", "tests"), ("p/mod/Other.py", "p", "modz"), ("q/mod/price.py", "q", "mod")], "path string, project string, zone_name string")
    fns = spark.createDataFrame([("p/mod/price.py::calc", "p", "p/mod/price.py", "calc", None), ("p/mod/Other.py::load", "p", "p/mod/Other.py", "load", "Repo"), ("p/tests/test_a.py::check_all", "p", "p/tests/test_a.py", "check_all", None)], "fn_id string, project string, file string, fn_name string, class_name string")
    attrs = spark.createDataFrame([("p", "Client", "invoices", "p/mod/Other.py")], "project string, class_name string, attr string, path string")
    docs = spark.createDataFrame([(1, "p", "fix mod/price.py::calc and if(x) now"), (2, "p", "call Repo.load( and Client.invoices"), (3, "p", "see OTHER.py"), (4, "p", "the modz part"), (5, "p", "check_all is slow"), (6, "p", "check_all in tests/ is slow"), (7, "p", None), (8, "zz", "mod/price.py")], "doc_id int, project string, text string")
    got = {(r.doc_id, r.kind, r.target.split("/")[-1], r.how) for r in R.resolve_targets(docs, files, fns, attrs).collect()}
    assert {x for x in got if x[0] == 1} == {(1, "path", "price.py", "explicit"), (1, "function", "price.py::calc", "explicit")}
    assert {x for x in got if x[0] == 2} == {(2, "function", "Other.py::load", "explicit"), (2, "path", "Other.py", "explicit"), (2, "attribute", "Client.invoices", "explicit")}
    assert {x for x in got if x[0] == 3} == {(3, "path", "Other.py", "explicit")}
    assert {x for x in got if x[0] == 4} == {(4, "zone", "modz", "fuzzy"), (4, "path", "price.py", "fuzzy"), (4, "path", "Other.py", "fuzzy")}
    assert not {x for x in got if x[0] in (5, 7, 8)} and (6, "function", "test_a.py::check_all", "fuzzy") in got
    w = spark.createDataFrame([("p/mod/price.py::calc",), ("load",), ("none",)], "raw string")
    assert {r.fn_id for r in R.function_by_name(w, fns).collect()} == {"p/mod/price.py::calc", "p/mod/Other.py::load"}


RULES = "id int, category string, title string, content string, source string, affects array<string>"


def test_rules_and_insights(spark):
    rules = spark.createDataFrame([(1, "data", "t1", "c", "manual", ["a.py"]), (2, "data", "t2", "c", "auto", None), (3, "coherence", "t3", "c", "auto", ["core/a.py", "b.py"])], RULES)
    assert [r.title for r in C.rules_of_category(rules, "data").orderBy("id").collect()] == ["t1", "t2"]
    assert {(r.kind, r.category) for r in C.rules_of_category(rules, "nope").collect()} == {("available", "data"), ("available", "coherence")}
    assert {(r.category, r.n, r.titles) for r in C.rules_by_category(rules).collect()} == {("data", 2, "t1|t2"), ("coherence", 1, "t3")}
    assert [tuple(r) for r in C.coherent_rules(spark.createDataFrame([("x/core/a.py",), ("q.py",)], "path string"), rules).collect()] == [("x/core/a.py", 3)]
    calls = spark.createDataFrame([("mcp__rule_read", "data"), ("rule_read", "data"), ("Read", "data")], "name string, argument string")
    assert [tuple(r) for r in C.rule_requests(calls, rules).collect()] == [("data", 2, 2)]
    assert [r.id for r in C.delete_rules(rules, rules.where("id = 2")).orderBy("id").collect()] == [1, 3]
    assert one(spark, C.delete_positions(F.array(F.lit("a"), F.lit("b"), F.lit("c")), [1])) == ["a", "c"]
    t = lambda *rows: spark.createDataFrame(list(rows), "name string, text string")
    asked = spark.createDataFrame([("errors",), ("core",), ("big.py",), ("?",)], "asked string")
    got = {(r.asked, r.found_as) for r in C.convention_of(t(("errors", "x")), asked, t(("core", "y")), t(("big.py", "z"))).collect()}
    assert got == {("errors", "aspect"), ("core", "zone"), ("big.py", "file"), ("?", "error")}
    ins = spark.createDataFrame([(1, "x", "d1", "high", "open", 1), (2, "x", "d2", "medium", "open", 2), (3, "y", "d3", "medium", "open", 1), (4, "y", "d4", "high", "fixed", 9)], "id int, target string, description string, priority string, status string, occurrences int")
    assert sorted(r.id for r in C.urgent_insights(ins).collect()) == [1, 2]
    assert {(r.target, r.texts) for r in C.insights_by_target(ins).collect()} == {("x", "d1\nd2"), ("y", "d3\nd4")}
    assert {r.id for r in C.mark_fixed(ins, ins.where("id = 2").select("id")).where("status = 'open'").collect()} == {1, 3}
    deb = spark.createDataFrame([("s1", "STYLE", "d", "low"), ("s2", "DEBT", "d", "low")], "session_id string, category string, description string, priority string")
    sc = spark.createDataFrame([("s1", 0.9, 12), ("s2", 0.2, 30)], "session_id string, score double, complexity_delta int")
    assert {(r.session_id, r.category, r.priority) for r in C.debt_insights(deb, sc).collect()} == {("s1", "STYLE", "low"), ("s1", "DEBT", "high"), ("s2", "DEBT", "high")}
    gaps = tools.sync_gaps(spark.createDataFrame([("breaks Rule #3 here",), ("none",)], "text string"), spark.createDataFrame([(3, ["a", "b"])], "id int, sync_with array<string>"), spark.createDataFrame([("a",)], "path string"))
    assert [tuple(r) for r in gaps.collect()] == [(3, "b")]


def test_caches_and_retention(spark):
    f = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", None)], "fn_id string, ast_hash string")
    e = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "a")], "source_fn string, target_fn string")
    none = spark.createDataFrame([], "fn_id string, content_hash string")
    first = C.impact_cache(f, e, none)
    assert {(r.fn_id, r.state) for r in C.impact_cache(f, e.union(spark.createDataFrame([("z", "b")], e.schema)), first.select("fn_id", "content_hash")).collect()} == {("a", "reuse"), ("b", "analyse")}
    up = lambda texts: [t.upper() for t in texts]
    rows, cache = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string"), spark.createDataFrame([("a", "kept")], "k string, v string")
    assert sorted((r.k or "", r.v) for r in C.cached(rows, cache, "k", "v", up).collect()) == [("", None), ("a", "kept"), ("b", "B"), ("b", "B")]
    now, taken = C.take_once(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,)], "id int"))
    assert [r.id for r in now.collect()] == [2] and {r.id for r in taken.collect()} == {1, 2}
    t = datetime(2026, 1, 10)
    s = spark.createDataFrame([("p", f"s{i}", t - timedelta(days=i)) for i in range(12)], "project string, session_id string, started_at timestamp")
    assert {r.session_id for r in C.retained_sessions(s, most=5).collect()} == {f"s{i}" for i in range(5)}
    assert C.markdown_audit(spark.createDataFrame([("u", f"i{i:02d}", "file") for i in range(12)], "kind string, id string, reason string")).first().text.endswith("… 2 more")


def test_places_and_sums_within_keys(spark):
    rows = [("a", i, i % 3) for i in range(50)] + [("b", 7, 1), (None, 1, 1), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): r.n for r in numbered(df, "k", [F.col("o")], "n").collect()}
    assert got == {**{("a", i): i + 1 for i in range(50)}, ("b", 7): 1, (None, 1): 1, (None, 2): 2}
    sums = {(r.k, r.o): r.s for r in running_sum(df, "k", [F.col("o")], "v", "s").collect()}
    assert sums[("a", 49)] == sum(i % 3 for i in range(50)) and sums[(None, 2)] == 1 and numbered(df.limit(0), "k", [F.col("o")], "n").count() == 0


def test_scores_and_bindings(spark):
    cols = "session_id string, status string, tests_passed boolean, session_end string, corrections int, files_created int, complexity_delta int, max_function_lines int, biggest_file_growth int, import_edges_delta int"
    rows = [("good", "committed", True, "agent_done", 0, 1, 0, 10, 5, 0), ("bad", "reverted", False, "user_killed", 3, 0, 25, 200, 300, 9), ("bare", "uncommitted", None, None, None, None, None, None, None, None)]
    got = {r.session_id: (r.score, r.commit, r.tests, r.debt) for r in N.score(spark.createDataFrame(rows, cols)).collect()}
    assert got["good"][0] == 1.0 and got["bad"][0] == 0.0 and got["bare"] == (0.7, "no_commit", "no_data", "no_data")
    t = datetime(2026, 1, 1, 12)
    s = spark.createDataFrame([("s", "p", t, t + timedelta(hours=1)), ("old", "p", datetime(1970, 1, 1), t), ("turned", "p", t, t - timedelta(days=3))], "session_id string, project string, started_at timestamp, completed_at timestamp")
    c = spark.createDataFrame([("c1", "p", t + timedelta(minutes=10), False), ("auto", "p", t + timedelta(minutes=62), True), ("late", "p", t + timedelta(minutes=70), False)], "commit_id string, project string, at timestamp, auto boolean")
    assert {(r.session_id, r.commit_id) for r in N.bind_in_window(s, c).collect()} == {("s", "c1")}
    m = spark.createDataFrame([("p", "abcdef1234", "x"), ("p", "1111111aaa", 'Revert "x" This reverts commit abcdef1234.')], "project string, commit_id string, message string")
    assert [r.commit_id for r in N.reverted_commits(m).collect()] == ["abcdef1234"]


def test_work_area_and_overview(spark):
    top = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.2), ("r", "b", 0.1)], "query_id string, id string, score double")
    units = spark.createDataFrame([("a", "function_unit", "A", "d" * 300)], "id string, kind string, unit_name string, description string")
    got = {(r.query_id, r.id): (r.kind, r.verdict, len(r.description or "")) for r in tools.find_work_area(top, units, spark.createDataFrame([("a", "f.py")], "fn_id string, file string")).collect()}
    assert got == {("q", "a"): ("function_unit", "OK", 250), ("q", "b"): ("unknown", "OK", 0), ("r", "b"): ("unknown", "NO_CLEAR_MATCH", 0)}
    lines = lambda n: spark.range(n).select(F.lit("x" * 40).alias("line"))
    out = {r.section: r.how for r in tools.orient([("a", lines(10)), ("b", lines(100)), ("c", lines(1000)), ("d", lines(2))], 400, 50).collect()}
    assert out == {"a": "full", "b": "short", "c": "skipped", "d": "full"}


def test_write_pipeline(spark, tmp_path):
    from codeloom.streaming.pipeline import run_writes, stored_functions

    w = "session string, path string, project string, prog_lang string, content string, at timestamp"
    edges = spark.createDataFrame([("b.py::g", "a.py::f")], "source_fn string, target_fn string")
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    t = datetime(2026, 1, 1)

    def write(*files):
        spark.createDataFrame([("s", p, "p", "python", c, t) for p, c in files], w).coalesce(1).write.mode("append").parquet(src)
        q = run_writes(spark.readStream.schema(w).option("maxFilesPerTrigger", 100).parquet(src), store, edges, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()

    write(("a.py", "def f(x): pass\ndef h(): pass\n"), ("b.py", "def g(): f(1)\n"))
    assert {r.fn_id for r in stored_functions(spark, store).collect()} == {"a.py::f", "a.py::h", "b.py::g"}
    write(("a.py", "def f(y): pass\n"), ("b.py", "def g(): f(1)\n"))
    assert {r.fn_id for r in stored_functions(spark, store).collect()} == {"a.py::f", "b.py::g"}
    assert [(r.warning, r.target, r.detail) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{store}/warnings").collect()] == [("broken_caller", "a.py::f", "changed")]
