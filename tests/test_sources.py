"""Lexer, scanners and stores on inline files."""

import subprocess

from codeloom.sources import facts, scan, store
from codeloom.sources.spans import spans


def names(text, lang):
    return [f.name for f in spans(text, lang)[1]]


def test_functions_of_each_language():
    assert names('def a(x):\n    """d"""\n    return "def no(): pass"\n# def no2(): pass\nclass C:\n    async def b(self): pass\n', "python") == ["a", "b"]
    assert names("export const a = (x: number): number => { return x; };\nclass C { get v() { return 1; } async m(x) { if (x) { f(x); } } }\n// function no() {}\nfunction b() { return `function no() {${1}}`; }", "typescript") == ["a", "v", "m", "b"]
    assert names("class A { /* int no() {} */ @Override public long f(int a) throws E { return new B(a); } void g() {} }", "java") == ["f", "g"]
    assert names("package p\nfunc (r *T) M(a int) int { return a }\nfunc F() {}\nvar s = `func no() {}`", "go") == ["M", "F"]
    assert names('pub(crate) async fn f<T>(a: &T) -> i64 { let s = r#"fn no() {}"#; 1 }\ntrait X { fn g(&self); }', "rust") == ["f", "g"]
    assert names("class A { [Test]\n public int F(int a)\n {\n return a; }\n int G() => 1; string s = @\"void No() {}\"; }", "csharp") == ["F", "G"]
    assert names("", "python") == [] and names("x", "cobol") == []


def test_scanners(spark):
    py = 'S = {"a", "b", 3}\nclass C(Base):\n    x = Field(1)\n    def __init__(self):\n        self.r = Repo()\n@app.route("/p", methods=["GET", "POST"])\ndef f(v):\n    return d["a"] if v == "b" else g("c")\n'
    files = spark.createDataFrame([("a.py", "python", py), ("b.py", "python", "class Repo: pass"), ("c.py", "python", "def broken(:"), ("d.py", "python", None)], "path string, prog_lang string, content string")
    assert [(r.name, r["values"]) for r in scan.value_collections(files).collect()] == [("S", ["a", "b", "3"])]
    assert ("C", "x", "Field") in {(r.class_name, r.attr, r.ctor) for r in scan.class_attributes(files).collect()}
    assert [(r.attr, r.target_class, r.target_file) for r in scan.init_attributes(files).collect()] == [("r", "Repo", "b.py")]
    assert {(r.value, r.kind) for r in scan.literal_use_kinds(files).collect()} >= {("a", "subscript"), ("b", "comparison"), ("c", "call_arg")}
    assert [(r.fn_name, r.route, r.http_method) for r in scan.decorated_routes(files).collect()] == [("f", "/p", "POST")]
    f = {r.fn_name: r for r in facts.functions(files).collect()}
    assert f["f"].complexity == 2 and [p.name for p in f["f"].params] == ["v"] and f["__init__"].params == [] and f["__init__"].class_name == "C"
    assert [(r.class_name, r.n_attributes, r.n_methods) for r in scan.class_sizes(files, facts.functions(files)).orderBy("class_name").collect()] == [("C", 1, 1), ("Repo", 0, 0)]


def shape(code):
    return facts.shape_hash(facts.code_of(code, "python"), "python")


def test_clone_hash_ignores_names_and_comments():
    assert shape("def f(a):\n    # c\n    return a + 1") == shape('def g(b):\n    """Adds."""\n    return b + 1')
    assert shape("def f(a): return a") != shape("def f(a): return a + a")
    assert shape("def f(a): return '# no comment'") != shape("def f(a): return '# another'")
    assert shape("") is None


def fact(text, lang):
    return facts.facts(text, lang)


def params(text, lang):
    f, ts, _, _ = fact(text, lang).functions[0]
    return facts.parameters(ts, f.name, lang), facts.return_type(ts, f.name, lang)


def test_parameters_and_return_types():
    assert params("async def f(self, a: dict[str, int], *args, b=3, **kw) -> list[int]:\n    pass", "python") == ([("a", "dict[str, int]", None), ("b", None, "3")], "list[int]")
    assert params("export async function f(a: number, b?: string, c = 1): Promise<number> { return 1; }", "typescript") == ([("a", "number", None), ("b", "string", None), ("c", None, "1")], "Promise<number>")
    assert params("func (r *T) M(a, b int, c string) (int, error) { return 1, nil }", "go") == ([("a", "int", None), ("b", "int", None), ("c", "string", None)], "(int, error)")
    assert params("pub fn f<T>(&self, mut a: Vec<T>, b: &str) -> Option<T> { None }", "rust") == ([("a", "Vec<T>", None), ("b", "&str", None)], "Option<T>")
    assert params("class A { public static Map<String, Integer> f(final List<String> a, int b) { return null; } }", "java") == ([("a", "List<String>", None), ("b", "int", None)], "Map<String, Integer>")
    assert params("class A { public int F(ref int a, string b = \"x\") { return a; } }", "csharp") == ([("a", "int", None), ("b", "string", '"x"')], "int")


def test_imports_of_each_language():
    got = lambda text, lang: [(x.capture.split(".")[1], x.text) for x in fact(text, lang).imports]
    assert got("import os.path, json as j\nfrom a.b import (c,\n    d as e)\ns = 'import no'\n", "python") == [("module", "os.path"), ("module", "json"), ("module", "a.b"), ("name", "c"), ("name", "d")]
    assert got("import { a, b as c } from './m';\nimport D from \"x\";\nimport 'y';\n", "typescript") == [("module", "./m"), ("name", "a"), ("name", "b"), ("module", "x"), ("name", "D"), ("module", "y")]
    assert got('package p\nimport (\n "fmt"\n l "log"\n)\nimport "os"\n', "go") == [("module", "fmt"), ("module", "log"), ("module", "os")]
    assert got("use std::io::{self, Read};\nuse a::b;\n", "rust")[0] == ("module", "std::io") and ("module", "a::b") in got("use a::b;\n", "rust")
    assert got("import java.util.List;\nclass A {}", "java") == [("module", "java.util.List")]
    assert got("using System;\nusing X = A.B;\nclass A {}", "csharp") == [("module", "System"), ("module", "A.B")]


def test_classes_exports_and_calls():
    py = "class A(Base, metaclass=M):\n    def f(self):\n        self.r.save(1)\n        json.dumps(f'{g(2)}')\n\ndef g(x): return h(x)\ndef _p(): pass\n"
    x = fact(py, "python")
    assert [tuple(c) for c in x.classes] == [("A", "Base", 1, 4)] and [e[0] for e in x.exports] == ["g", "A"]
    assert [(c.callee, c.receiver, c.expression) for c in x.calls] == [("save", "self.r", "self.r.save(1)"), ("dumps", "json", "json.dumps(f'{g(2)}')"), ("h", None, "h(x)")]
    assert [f[2] for f in x.functions] == ["A", None, None]
    go = fact("package p\ntype T struct {\n A int\n}\nfunc F() { g() }\nfunc f() {}\n", "go")
    assert [c.name for c in go.classes] == ["T"] and [e[0] for e in go.exports] == ["F", "T"] and [c.callee for c in go.calls] == ["g"]
    assert fact("x", "cobol") == facts.Facts([], [], [], [], []) and fact("", "python").functions == []


def test_edges_from_source(spark):
    from codeloom.operators import graph as G

    text = {
        "p/a.py": "import util\nfrom b import helper\nclass S:\n    def __init__(self):\n        self.r = Repo()\n    def run(self):\n        self.r.save()\n        other.save()\n        helper(1)\n        util.only()\n        local()\ndef local(): pass\n",
        "p/b.py": "def helper(x): pass\nclass Repo:\n    def save(self): pass\n", "p/util.py": "def only(): pass\n", "p/c.py": "def helper(x): pass\n",
    }
    files = spark.createDataFrame([(p, "p", "python", c) for p, c in text.items()], "path string, project string, prog_lang string, content string")
    f = facts.functions(files).selectExpr("concat(path, '::', fn_name) fn_id", "'p' project", "path file", "fn_name", "class_name", "line_start", "line_end")
    e = G.edges_from_calls(facts.calls(files), f, facts.imports(files), scan.init_attributes(files)).collect()
    assert {(r.source_fn.split("::")[1], r.target_fn, r.confidence) for r in e} == {("run", "p/b.py::save", 0.85), ("run", "p/b.py::helper", 1.0), ("run", "p/util.py::only", 0.5), ("run", "p/a.py::local", 0.95)}
    assert facts.file_rows(files).count() == 4


def test_html(spark):
    html = '<h1 id="t">Title</h1><form id="f" action="/x"><input id="i" name="n"></form><div class="tab-pane" id="o"><div class="subpane" id="p">\n</div></div><span id="s"></span>'
    files = spark.createDataFrame([("t.html", None, html)], "path string, prog_lang string, content string")
    assert [(r.kind, r.id) for r in scan.html_elements(files).orderBy("pos").collect()] == [("heading", "t"), ("form", "f"), ("input", "i"), ("panel", "o"), ("indicator", "s")]
    assert [r.id for r in scan.html_sections(files).collect()] == ["p"]


def test_tree_and_git(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "config").mkdir()
    (tmp_path / "src/a.py").write_text("def f(): pass\n")
    (tmp_path / "node_modules/b.js").write_text("x")
    (tmp_path / "config/c.json").write_text("{}")
    assert [(r.path, r.prog_lang) for r in scan.read_sources(spark, str(tmp_path)).collect()] == [("src/a.py", "python")]
    assert [r.path for r in scan.read_data_files(spark, str(tmp_path)).collect()] == ["config/c.json"]
    git = ["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x"]
    subprocess.run([*git[:3], "init", "-q"], check=True)
    subprocess.run([*git, "add", "-A"], check=True)
    subprocess.run([*git, "commit", "-qm", "first"], check=True)
    store.register(spark)
    got = spark.read.format("git_log").option("path", str(tmp_path)).load()
    assert {(r.file, r.message) for r in got.collect()} >= {("src/a.py", "first")}


def test_graph_json(spark, tmp_path):
    p = tmp_path / "graph.json"
    p.write_text('{"functions": {"a::f": {"id": "a::f", "file": "a", "name": "f"}}, "call_edges": [{"source_fn": "a::f", "target_fn": "a::f", "confidence": 1.0, "call_site": {"file": "a", "line": 3, "expression": "f()"}}]}')
    g = store.read_graph_json(spark, str(p))
    assert g["functions"].count() == 1 and g["edges"].first().line == 3 and g["files"].count() == 0
    store.write_graph({"edges": g["edges"]}, str(tmp_path / "out"), "2026-01-01")
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 1
