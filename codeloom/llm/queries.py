"""Queries of the training-data operators."""

from __future__ import annotations

from codeloom.llm.components import p1_found
from codeloom.llm.conversations import p3_conversations, p3_found
from codeloom.llm.docpairs import p2_found, p2_pairs
from codeloom.llm.languages import p4_found, p4_segments
from codeloom.llm.leakage import p8_found, p8_leaks
from codeloom.llm.mixing import p9_mix, p9_shares
from codeloom.llm.neighbours import p5_found
from codeloom.llm.stuffing import p10_found

QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_conversations": p3_conversations, "p4_found": p4_found, "p4_segments": p4_segments,
    "p5_found": p5_found, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found,
}

_KEY = "nullif(regexp_replace(regexp_replace(replace(trim({c}, E' \\t\\n\\r'), '\\', '/'), '/{{2,}}', '/', 'g'), '^(\\./)+', ''), '')"
_A, _B = _KEY.format(c="fn_a"), _KEY.format(c="fn_b")
_SCORE = "CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END"

#: SQL with the same rows, where SQL can express the whole-table result.
ORACLES: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE l AS (SELECT {_A} AS a, {_B} AS b FROM duplicate_matches WHERE (lower(kind) = 'exact' AND similarity IS NULL) OR {_SCORE} >= 0.7),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
reach AS (SELECT a AS n, a AS r FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT n AS fn_id, min(r) AS group_id FROM reach GROUP BY 1""",
}
