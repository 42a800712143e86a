"""Groups, conversations and neighbours against brute force, with skew and dirty input."""

import json
import random

import numpy as np
import pytest

from codeloom.llm import neighbours
from codeloom.llm.components import connected_groups, match_links
from codeloom.llm.conversations import conversations, kahn_order, message_rows
from codeloom.llm.neighbours import nearest_vectors, neighbour_pairs, usable_vectors


def brute_groups(links):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            for x in (a, b):
                parent.setdefault(x, x)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed,rounds", [(0, 24), (1, 3)])
def test_groups_equal_union_find(spark, seed, rounds):
    rnd = random.Random(seed)
    links = [(f"n{rnd.randrange(120):03d}", f"n{rnd.randrange(120):03d}") for _ in range(50)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [("hub", f"h{i}") for i in range(40)]
    links += [("h0", "c05")] * seed + [links[0], links[0][::-1], ("x", None)]
    got = {r.id: r.group_id for r in connected_groups(spark.createDataFrame(links, "a string, b string"), rounds).collect()}
    assert got == brute_groups(links)


def test_links_of_dirty_matches(spark):
    rows = [("a", "./b", "near", 0.7), ("b ", "a", "NEAR", 70.0), ("c", "d", "Exact", None), ("e", "f", "near", None), ("g", "h", "near", 0.69), ("i", "i", "exact", 1.0), ("j", None, "exact", 1.0), ("k", "l", "exact", float("nan")), ("m", "n", "near", 69.9), ("", "o", "near", 1.0)]
    df = spark.createDataFrame(rows, "fn_a string, fn_b string, kind string, similarity double")
    assert {(r.a, r.b) for r in match_links(df).collect()} == {("a", "b"), ("c", "d"), ("k", "l")}
    assert connected_groups(match_links(df.limit(0))).count() == 0


T = "session_id string, entry_type string, ts string, uuid string, parent_uuid string, message string, received_at timestamp, cwd string"


def say(session, kind, uuid, parent, ts, text="hi", role=None, got="2026-01-01 00:00:00"):
    from datetime import datetime

    body = json.dumps({"role": role or kind, "content": text}) if text is not None else None
    return (session, kind, ts, uuid, parent, body, datetime.fromisoformat(got), "/x")


def test_conversations_kept_and_dropped(spark):
    z = "2026-01-01T00:00:0%dZ"
    rows = [
        say("S", "user", "a", None, z % 1), say("{s} ", "assistant", "b", "a", z % 1), say("s", "assistant", "b", "a", z % 1, got="2026-01-02 00:00:00"), say("s", "user", "c", "b", None, [{"type": "tool_result"}]), say("s", "user", "d", "c", None, [{"type": "text", "text": "x"}]), say("s", "assistant", "e", "d", "2026-01-01T01:00:05+01:00"),
        say("open", "user", "1", None, z % 1), say("late", "assistant", "2", None, z % 1), say("orphan", "user", "3", "zz", z % 1), say("orphan", "assistant", "4", "3", z % 2),
        say("bad", "user", "5", None, z % 1), say("bad", "assistant", "6", "5", z % 2, None), say("role", "user", "7", None, z % 1), say("role", "assistant", "8", "7", z % 2, role="user"),
        say("mute", "user", "9", None, z % 1, " "), say(None, "user", "10", None, z % 1), say("ring", "user", "11", "12", z % 1), say("ring", "assistant", "12", "11", z % 2),
    ]
    df = message_rows(spark.createDataFrame(rows, T))
    want = {("s", 0, "a"), ("s", 1, "b"), ("s", 2, "d"), ("s", 3, "e")}
    assert {(r.session_id, r.time_pos, r.uuid) for r in conversations(df).collect()} == want
    assert {(r.session_id, r.time_pos, r.uuid) for r in conversations(df, session_rows=1).collect()} == want
    assert conversations(df.limit(0)).count() == 0


def test_kahn_reports_cycles_and_orphans():
    assert kahn_order(["a", "b"], ["b", "a"], [1, 2])[3:] == (False, True)
    assert kahn_order(["a"], ["q"], [1])[3:] == (True, False)
    assert kahn_order(["b", "a"], ["a", None], [5, 5])[0] == [1, 0]


def test_kahn_keeps_replies_behind_what_they_answer():
    order, by_time, breaks, _, _ = kahn_order(["a", "b", "c"], [None, "a", "b"], [5, 3, 9])
    assert order == [0, 1, 2] and by_time == [1, 0, 2] and breaks == [False, True, False]


def test_large_sessions_have_the_same_order(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(40):
        n = rnd.randrange(2, 14)
        for i in range(n):
            parent = None if i == 0 else f"u{rnd.randrange(i)}" if rnd.random() < 0.97 else rnd.choice(["zz", f"u{n - 1}", None])
            ts = None if rnd.random() < 0.3 else f"2026-01-01T00:00:0{rnd.randrange(3)}Z"
            rows.append(say(f"s{k:02d}", "user" if i % 2 == 0 else "assistant", f"u{i}", parent, ts, text=" " if rnd.random() < 0.1 else "hi"))
    df = message_rows(spark.createDataFrame(rows, T)).cache()
    small, large = ({tuple(r) for r in conversations(df, n).collect()} for n in (1000, 1))
    assert small == large and len({r[0] for r in small}) > 8 and any(r[5] for r in small)


def brute_pairs(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(ids)):
        best = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in best}
    return out


def test_neighbours_recall_with_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = np.vstack([centres[rng.integers(12, size=260)] + 0.15 * rng.normal(size=(260, 16)), np.repeat(centres[:1], 90, axis=0)]).astype(np.float32)
    ids = [f"v{i:04d}" for i in range(len(x))]
    got = neighbour_pairs(nearest_vectors(spark.createDataFrame(list(zip(ids, x.tolist())), "id string, vec array<float>"), dim=16)).collect()
    got, want = {(r.id_a, r.id_b) for r in got}, brute_pairs(ids, x.astype(float))
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_neighbours_in_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MEMBERS", 100)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=16) / 4 + 0.06 * rng.normal(size=(700, 16))).astype(np.float32)
    ids = [f"v{i:04d}" for i in range(len(x))]
    got = neighbour_pairs(nearest_vectors(spark.createDataFrame(list(zip(ids, x.tolist())), "id string, vec array<float>"), dim=16)).collect()
    got, want = {(r.id_a, r.id_b) for r in got}, brute_pairs(ids, x.astype(float))
    assert len(got & want) / len(want) >= 0.999


def test_unusable_vectors_and_tiny_tables(spark):
    rows = [("a", "h", [1.0, 0.0], 1), ("a", "h", [0.0, 1.0], 2), ("b", "h", [0.0, 0.0], 1), ("c", "h", None, 1), ("d", "h", [1.0], 1), ("e", "h", [float("nan"), 1.0], 1), ("f", "h", [0.0, 2.0], 1), (None, "h", [1.0, 1.0], 1), ("g", "h", [float("inf"), 1.0], 1)]
    ok = usable_vectors(spark.createDataFrame(rows, "id string, hash string, vec array<float>, built_at int"), 2)
    assert sorted(r.id for r in ok.collect()) == ["a", "f"]
    assert [(r.id_a, r.id_b) for r in neighbour_pairs(nearest_vectors(ok, dim=2)).collect()] == [("a", "f")]
    assert nearest_vectors(ok.limit(0), dim=2).count() == 0
