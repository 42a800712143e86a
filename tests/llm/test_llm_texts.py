"""Documentation pairs, languages, leakage, mixing and stuffing on small texts."""

import os

import numpy as np
import pytest

from codeloom.llm import docpairs as D
from codeloom.llm import languages as L
from codeloom.llm import leakage as K
from codeloom.llm import mixing as M
from codeloom.llm import stuffing as S
from codeloom.llm.bigru import ByteGRU, pack

FILES = "path string, prog_lang string, content string, read_at int, project string"


def documented(spark, **files):
    rows = [(p.replace("_", "."), None, c, 1, "x") for p, c in files.items()]
    return {r.fn_id for r in D.documented_functions(spark.createDataFrame(rows, FILES)).collect()}


def test_documentation_of_each_language(spark):
    got = documented(
        spark,
        a_py='def f():\n    # note\n    """Adds the tax."""\n\ndef g():\n    x = 1\n    """Not a docstring at all."""\n\ndef h():\n    f"""Neither is this one."""\n',
        a_ts="/** Sorts the open rows. */\n@Dec()\nexport function f() {}\n/** Left behind by a statement. */\nconst x = 1;\nfunction g() {}\n/* Plain comment here. */\nfunction h() {}\n",
        a_go="// F sums the open rows.\nfunc F() {}\n\n// G is apart from its text.\n\nfunc G() {}\n\nx := 1 // trailing remark here\nfunc H() {}\n",
        a_rs="/// Sums the open rows.\n#[inline]\npub fn f() {}\n// Plain remark here.\nfn g() {}\n//// Four slashes here.\nfn h() {}\n",
        a_cs="class A {\n/// <summary>\n/// Sums the open rows.\n/// </summary>\n[Test]\npublic int F(int a)\n{ return a; }\n/// <param name=\"a\">the first</param>\npublic int G(int a) { return a; }\n}",
        a_java="class A { /** Sums the open rows. */ @Override public int f() { return 1; } /** {@inheritDoc} */ public int g() { return 1; } }",
    )
    assert got == {"a.py::f", "a.ts::f", "a.go::F", "a.rs::f", "a.cs::F", "a.java::f"}


@pytest.mark.parametrize("doc", ["", "TODO", "TODO: write docs", "FIXME", "N/A", "...", "---", "No description.", "Auto-generated stub.", "docs go here", "The load price.", "load_price", "@param a the price", ":return:"])
def test_trivial(doc):
    assert D.is_trivial(D.documentation(doc, "java" if doc.startswith("@") else "python"), "load_price")


@pytest.mark.parametrize("doc", ["Returns cents, never a fraction.", "TODO list aside, sorts the rows.", "Loads the price of a seat."])
def test_not_trivial(doc):
    assert not D.is_trivial(D.documentation(doc, "python"), "load_price")


def test_last_read_file_holds(spark):
    rows = [("./a.py", None, "def f():\n    '''Adds the tax.'''", 1, "x"), ("a.py", None, "def g():\n    '''Adds the tax.'''", 2, "x"), (None, None, "def h(): pass", 1, "x"), ("b.py", None, None, 1, "x"), ("c.py", None, "", 1, "x")]
    assert {r.fn_id for r in D.documented_functions(spark.createDataFrame(rows, FILES)).collect()} == {"a.py::g"}


def test_network_learns_and_gradients_agree():
    net = ByteGRU(2, hidden=6, seed=1)
    texts = [b"the cat and the dog", b"der hund und die katze", b"a house in the town", b"ein haus in der stadt"] * 6
    y = np.array([0, 1, 0, 1] * 6)
    losses = net.train(texts, y, 25, batch=8)
    assert losses[-1] < 0.25 * losses[0]
    ids, mask = pack([b"abc", b"defgh"])
    loss, grad = net.gradients(ids, mask, np.array([0, 1]))
    k, e = "uf", 1e-2
    at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
    old = net.p[k][at]
    net.p[k][at] = old + e
    up = net.gradients(ids, mask, np.array([0, 1]))[0]
    net.p[k][at] = old - e
    down = net.gradients(ids, mask, np.array([0, 1]))[0]
    assert abs((up - down) / (2 * e) - grad[k][at]) < 0.05 * abs(grad[k][at]) + 1e-4


def test_held_out_accuracy(spark, data):
    rows = L.labelled_texts(spark, os.path.dirname(data) + "/sf0.01").where("text is not null").collect()
    known = [(r.text, code) for r in rows if r.label and (code := L.LABELS.get("".join(ch for ch in r.label.lower().split("-")[0] if ch.isalpha()))) and code != "zxx"]
    train, test = known[::2], known[1::2]
    net = ByteGRU.from_state(L.fit(train))
    cut = [L.text_parts(t) for t, _ in test]
    parts = list(dict.fromkeys(p for c in cut for p in c))
    runs = dict(zip(parts, L.label_parts(net, parts)))
    got = [L.languages_of(c, runs) for c in cut]
    same = [g[0][0] == code for g, (_, code) in zip(got, test) if len(g) == 1 and g[0][0] != "zxx"]
    assert np.mean(same) > 0.88  # a tenth of the labels held against is wrong by itself


def test_code_is_no_language_and_labels_in_any_spelling(spark):
    assert L.text_parts("{4: 0x482086} @@ web/stock_plot.py") == [] and L.languages_of([], {}) == [("zxx", 1.0, 1.0)]
    df = spark.createDataFrame([("en-US", "en"), ("Ukrainian", "uk"), ("ZH_cn", "zh"), ("Brazilian", None), ("Brazilian Portuguese", "pt"), ("Chinese (Simplified)", "zh"), ("n/a", None), ("  ", None), (None, None)], "x string, want string")
    assert all(r.got == r.want for r in df.select("want", L.label_code(df.x).alias("got")).collect())
    assert [r.m for r in df.select(L.is_missing(df.x).alias("m")).collect()] == [False, False, False, False, False, False, True, True, True]


def test_leaks_with_edits_layout_and_marks(spark):
    item = "Report when old keepers halves 24 crates of rebate before week 11 and both crews weighs every noble ticket near the bridge"
    words = item.split()
    docs = [
        (1, "Intro. <b>" + item.upper() + "</b> End."), (2, "# " + "\n# ".join(words[i] for i in range(len(words)))), (3, " ".join(words[:14])), (4, " ".join(words[2:17])),
        (5, " ".join("really" if i == 8 else w for i, w in enumerate(words))), (6, " ".join("x" if i % 3 == 0 else w for i, w in enumerate(words))), (7, None), (8, ""),
        (9, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in item)), (10, "**Old** kee­pers " + item.replace("crates", "cra­tes")),
    ]
    got = K.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "s", item), (2, "s", None)], "item_id int, suite string, text string"))
    assert {r.doc_id for r in got.where("kind = 'copy'").collect()} == {1, 2, 4, 5, 9, 10}


def test_long_documents_are_aligned_piece_by_piece(spark):
    item = "Report when old keepers halves 24 crates of rebate before week 11 and both crews weighs every noble ticket near the bridge"
    filler = "the keepers of the bridge and the crates of the week " * 40_000
    docs = [(1, item + " " + filler + item), (2, filler)]
    got = K.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert [(r.doc_id, r.words) for r in got.where("kind = 'copy'").collect()] == [(1, len(item.split()))]
    assert K.stretches([0, 1, 50], 20) == [(0, 282), (6380, 6554)]


def test_reparameterised_items_are_told_apart():
    item = "a train of 12 wagons leaves at 9 and meets 12 carts after 40 minutes on the way".split()
    other = [{"12": "15", "9": "8", "40": "55"}.get(w, w) for w in item]
    mixed = [w if i != 9 else "99" for i, w in enumerate(other)]
    assert K.reparameterised(other, item) and not K.reparameterised(item, item)
    assert not K.reparameterised(["x"] * 20, item) and mixed != other


@pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no vocabulary file")
def test_mix_meets_shares_within_repeats(spark):
    docs = [(i, "big" if i < 900 else "small", "one two three four five " * (1 + i % 4)) for i in range(1000)] + [(2000, None, "x y"), (2001, "other", "x y z"), (2002, "big", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 2), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    mixed, shares = M.mix(df, targets)
    s = {r.source: r for r in shares.collect()}
    assert s["small"].rate == 2.0 and 0.6 < s["big"].rate < 0.8 and s["absent"].rate == 0
    rows = mixed.collect()
    assert sum(r.tokens for r in rows if r.source == "small") == s["small"].mixed_tokens == 2 * s["small"].available_tokens
    assert max(r.copy_no for r in rows if r.source == "big") == 1 and abs(s["big"].mixed_tokens / s["big"].available_tokens - s["big"].rate) < 0.06
    assert {(r.doc_id, r.copy_no) for r in rows} == {(r.doc_id, r.copy_no) for r in M.mix(df, targets)[0].collect()}
    empty = M.mix(df.limit(0), targets)
    assert empty[0].count() == 0 and empty[1].count() == 3


def test_stuffed_pages(spark):
    prose = "The scheduler sorts the open invoices after the lock is taken so that the report stays stable. Nobody on the team owns the price cache, so the loader clears it whenever a draft arrives. "
    links = "\n".join(f"https://a{i}.example/x/{i}" for i in range(40))
    explained = "\n".join(f"- [a{i}](https://a{i}.example/x) explains how the loader sorts open rows after each change of the table" for i in range(12))
    table = "\n".join(f"| load_{i} | {i} | {i * 3} |" for i in range(30))
    log = "\n".join(f"2026-01-{i:02d} INFO core/a.py load_{i} took {i} ms" for i in range(10, 28))
    docs = [(1, "free code search, debt report, clone finder, free code search, debt report. " * 12), (2, links), (3, prose * 3), (4, explained), (5, table), (6, log), (7, prose * 6 + links), (8, prose + links), (9, None), (10, " "), (11, "\n".join(f"Olive seat pack new AB-{i} {i}.99" for i in range(30)))]
    got = {r.doc_id for r in S.stuffed_pages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1, 2, 8, 11} - ({8} if len(links.split()) <= len(prose.split()) else set())
    assert S.stuffed_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pages_of_tags_alone_are_judged(spark):
    names = "order pallet reserve batch resolve sensor course intake score payout widget harvest build route policy session rebate fare lesson meter".split()
    pick = np.random.default_rng(5)
    tags = lambda n, mark, sep: sep.join(mark + names[i] for i in pick.integers(len(names), size=n))
    prose = "The scheduler sorts the open invoices after the lock is taken so that the report stays stable. Nobody on the team owns the price cache. "
    docs = [(1, tags(90, "#", " ")), (2, tags(60, "#", " ")), (3, prose + tags(90, "#", " ")), (4, tags(80, "", " - ")), (5, prose * 4 + tags(20, "#", " ")), (6, tags(80, "", ". "))]
    assert {r.doc_id for r in S.stuffed_pages(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1, 2, 3, 4, 6}


def test_edited_passage_beside_a_longer_fragment(spark):
    item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    other = [f"x{chr(97 + i)}" for i in range(10)]
    leak = item[4:11] + ["y"] + item[12:19]
    docs = [(1, item[21:35] + other + leak), (2, leak + other + item[21:35]), (3, item[21:35] + other + item[4:11] + ["y", "y"] + item[13:19]), (4, item[5:19] + item[30:40])]
    got = K.leaked_items(spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string"))
    assert {(r.doc_id, r.words, r.edits) for r in got.where("kind = 'copy'").collect()} == {(1, 15, 1), (2, 15, 1)}


def test_salad_without_separators_and_bare_domains(spark):
    pick = np.random.default_rng(7)
    names, acts, ends = "order pallet batch sensor course score widget harvest build route policy session".split(), "sorts checks keeps merges counts clears".split(), "before the page is drawn,after the lock is taken,once for each store,when the day ends".split(",")
    say = lambda: f"The {pick.choice(names)} loader {pick.choice(acts)} every open {pick.choice(names)} of the shared table {pick.choice(ends)} "
    prose = [" ".join(say() for _ in range(12)) for _ in range(160)]
    words = " ".join(prose).split()
    salad = " ".join(pick.permutation(words)[:400])
    domains = " ".join(f"site{chr(97 + i // 26)}{chr(97 + i % 26)}.example.com" for i in range(200))
    stuffed = "See https://a.example/x for this. " + "cheap price cache cheap price index " * 20
    docs = list(enumerate(prose)) + [(900, salad), (901, domains), (902, prose[0] + salad), (903, prose[0] + prose[1] + salad[: len(prose[0])]), (904, stuffed)]
    assert {r.doc_id for r in S.stuffed_pages(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {900, 901, 902, 904}


def test_limits_come_from_every_page_whatever_its_number(spark):
    pick = np.random.default_rng(7)
    names, acts, ends = "order pallet batch sensor course score widget harvest build route policy session".split(), "sorts checks keeps merges counts clears".split(), "before the page is drawn,after the lock is taken,once for each store,when the day ends".split(",")
    say = lambda: f"The {pick.choice(names)} loader {pick.choice(acts)} every open {pick.choice(names)} of the shared table {pick.choice(ends)} "
    prose = [" ".join(say() for _ in range(12)) for _ in range(160)]
    words = " ".join(prose).split()
    every = lambda n: " ".join(words[pick.integers(len(words))] if i % n == 0 else w for i, w in enumerate(" ".join(say() for _ in range(20)).split()))
    texts = prose + [every(n) for n in (2, 3, 4, 5, 6, 8, 10)]
    got = []
    for half in (0, 1):  # numbers whose hashes are all even, or all odd
        ids = [r.id for r in spark.range(2000).where(f"pmod(xxhash64(id), 2) = {half}").limit(len(texts)).collect()]
        got.append({ids.index(r.doc_id) for r in S.stuffed_pages(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()})
    assert got == [set(range(160, 167))] * 2


def test_quantiles_are_exact(spark):
    pick, parts = np.random.default_rng(3), [0.25, 0.5, 0.85]
    for v in (pick.normal(3, 2, 40_001), np.concatenate([np.full(700, 3.25), pick.normal(3, 1e-5, 500), [-9.0, 40.0]]), np.array([1.5])):
        r = S.quantiles(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "pmi double"), "pmi", parts).first()
        assert (r.k, r.q) == (len(v), [float(np.quantile(v, p, method="inverted_cdf")) for p in parts])
    assert S.quantiles(spark.createDataFrame([], "pmi double"), "pmi", parts).first() == (0, [None] * 3)


def test_switches_within_a_sentence_are_segments(spark, data):
    texts = L.labelled_texts(spark, os.path.dirname(data) + "/sf0.01").where("text is not null").cache()
    weights = L.fitted(spark, L.training_rows(texts))
    assert all((weights[k] == v).all() for k, v in L.fitted(spark, L.training_rows(texts)).items())
    keys = ["tbl", "record_id", "lang"]
    found = L.label_cases(L.detect(texts, weights)).select(*keys)
    segs = L.segments(texts, weights)
    assert found.join(segs.select(*keys), keys, "left_anti").count() == 0
    rows = segs.join(texts.select("tbl", "record_id", "text"), ["tbl", "record_id"]).collect()
    assert all(0 <= r.start_at < r.end_at <= len(r.text) and 0 < r.confidence <= 1.0001 and 0 <= r.share <= 1 for r in rows)
    one = "Die Nachtaufgabe sortiert alle offenen Rechnungen, (the loader keeps every open invoice of the table) nachdem die Sperre gesetzt ist."
    mixed = spark.createDataFrame([("t", "a", one, None)], "tbl string, record_id string, text string, label string")
    got = {(r.lang, one[r.start_at : r.end_at]) for r in L.segments(mixed, weights).collect()}
    assert {x[0] for x in got} == {"de", "en"} and any(lang == "en" and "keeps every open invoice" in t and len(t) < 70 for lang, t in got)


def test_reparameterised_items_by_numbers_names_and_units(spark):
    item = "Each morning Harper loads 12 crates within 40 minutes before Boston opens so that Harper meets 12 drivers near the old harbour"
    swap = lambda m: " ".join(m.get(w, w) for w in item.split())
    docs = [
        (1, swap({"12": "15", "40": "55", "Harper": "Quinn", "Boston": "Lisbon", "minutes": "hours"})),  # one change for each slot
        (2, " ".join({3: "Quinn", 15: "Blake"}.get(i, {"12": "15", "40": "55", "Boston": "Lisbon"}.get(w, w)) for i, w in enumerate(item.split())).replace("Harper", "Quinn", 1).replace("Harper", "Blake", 1)),  # one name, two replacements
        (3, item.lower()), (4, item.upper()), (5, "Intro of another kind. " + swap({"12": "7", "40": "9", "Boston": "Dublin"}) + " End."), (6, "12 15 18 21 24 27 30 33 36 39 42 45 48 51 54 57 60"),
    ]
    got = K.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert {(r.doc_id, r.kind) for r in got.collect()} == {(1, "reparameterised"), (3, "copy"), (4, "copy"), (5, "reparameterised")}
