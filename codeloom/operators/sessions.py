"""Agent sessions: roll-up, tools, scores, bindings, debouncing, suppression.

Input rows of parsed transcripts are entries(session_id, kind, t, message, tool_use_result);
rows without session are left out, unreadable messages count as entries without content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.keys import blank_to_null, plain_session, utc_millis

#: Fixed value: the parts of a message that are read.
MESSAGE = "model string, stop_reason string, usage struct<input_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long,output_tokens:long>"
#: Fixed value: what the message of an automatic commit holds.
AUTO_COMMIT = "auto-commit"
# What test runs print.
FAILED, PASSED, RUNNER = r"(?i)(\d+)\s+failed|FAILED|FAIL\b|error\b", r"(\d+)\s+passed", r"(?i)test session starts|\b(pytest|jest)\b"
#: Seconds of the buckets of interval joins.
HOUR_S, DAY_S = 3600, 86_400
_BLOCKS = "array<struct<type:string,text:string,name:string,input:struct<file_path:string,command:string>>>"


def entries(transcript: DataFrame) -> DataFrame:
    """Transcript rows with plain session ids, UTC times and the read parts of their messages; resent uuids once, the one received last."""
    rows = transcript.select(
        plain_session(F.col("session_id")).alias("session_id"), blank_to_null(F.col("uuid")).alias("uuid"), F.lower("entry_type").alias("kind"),
        utc_millis(F.col("ts")).alias("t"), F.when(F.try_parse_json("message").isNotNull(), F.col("message")).alias("message"), "tool_use_result", "received_at",
    ).where("session_id is not null")
    named = rows.where("uuid is not null")
    last = named.groupBy("session_id", "uuid").agg(F.max(F.struct("received_at", "kind", "t", "message", "tool_use_result")).alias("m"))
    out = last.select("session_id", "uuid", "m.kind", "m.t", "m.message", "m.tool_use_result").unionByName(rows.where("uuid is null").drop("received_at"))
    return out.withColumn("msg", F.from_json("message", MESSAGE)).withColumn("content", F.get_json_object("message", "$.content"))


def tool_calls(rows: DataFrame) -> DataFrame:
    """(session_id, t, name, class, file_path, tokens_in, tokens_out), one row per tool use of the assistant."""
    u = F.col("msg.usage")
    calls = rows.where("kind = 'assistant'").select("session_id", "t", (F.coalesce(u["input_tokens"], F.lit(0)) + F.coalesce(u["cache_read_input_tokens"], F.lit(0)) + F.coalesce(u["cache_creation_input_tokens"], F.lit(0))).alias("tokens_in"), F.coalesce(u["output_tokens"], F.lit(0)).alias("tokens_out"), F.explode(F.from_json("content", _BLOCKS)).alias("b"))
    calls = calls.where("b.type = 'tool_use'")
    return calls.select("session_id", "t", F.col("b.name").alias("name"), T.tool_class(F.col("b.name"), F.coalesce("b.input.command", F.lit(""))).alias("class"), F.col("b.input.file_path").alias("file_path"), "tokens_in", "tokens_out")


def tool_stats(calls: DataFrame) -> DataFrame:
    """Per tool: calls, tokens in, out, together and on average (whole)."""
    g = calls.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    total = F.col("tokens_in") + F.col("tokens_out")
    return g.select("name", "calls", "tokens_in", "tokens_out", total.alias("total"), F.floor(total / F.col("calls")).alias("average"))


def rollup(rows: DataFrame) -> DataFrame:
    """Per session: first and last time, entries, turns by class, files modified and created, corrections, last test result, how it ended."""
    user_text = F.when(F.col("kind") == "user", F.coalesce(F.when(~F.col("content").startswith("["), F.col("content")), F.array_join(F.transform(F.filter(F.from_json("content", _BLOCKS), lambda b: b["type"] == "text"), lambda b: b["text"]), " ")))
    out = F.when(F.col("kind") == "user", F.get_json_object("tool_use_result", "$.stdout"))
    tested = F.when(out.rlike(FAILED) & (out.rlike(PASSED) | out.rlike(RUNNER)), False).when(out.rlike(PASSED), True)
    e = rows.withColumns({"said": user_text, "tested": tested})
    base = e.groupBy("session_id").agg(
        F.min("t").alias("started_at"), F.max("t").alias("completed_at"), F.count(F.lit(1)).alias("entries"),
        F.count_if(F.coalesce(T.looks_like_correction(F.col("said")), F.lit(False))).alias("corrections"),
        F.max_by("tested", F.when(F.col("tested").isNotNull(), F.struct("t", "uuid"))).alias("tests_passed"),
        F.max_by("msg.stop_reason", F.when(F.col("kind") == "assistant", F.struct("t", "uuid"))).alias("stop"),
    )
    calls = tool_calls(rows).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), *[F.count_if(F.col("class") == c).alias(c) for c in ("exploration", "modification", "verification")],
        F.count_distinct(F.when(F.col("name").isin("Edit", "MultiEdit"), F.col("file_path"))).alias("files_modified"), F.count_distinct(F.when(F.col("name") == "Write", F.col("file_path"))).alias("files_created"),
    )
    end = F.when(F.col("stop") == "end_turn", "agent_done").when(F.col("stop") == "max_tokens", "max_turns").otherwise("user_killed")
    counts = ["turns", "exploration", "modification", "verification", "files_modified", "files_created"]
    return base.join(calls, "session_id", "left").fillna(0, counts).withColumn("session_end", end).drop("stop")


#: What each finding adds to a session's score of 0.5, which is held in 0..1.
SCORE_RULES = {
    "committed": 0.2, "reverted": -0.3, "tests_passed": 0.15, "tests_failed": -0.25, "unclean_end": -0.2, "corrected": -0.15, "no_more_complexity": 0.15, "complexity_over_10": -0.2,
    "complexity_over_20": -0.2, "long_function": -0.15, "file_growth": -0.15, "new_files": 0.15, "more_imports": -0.1, "no_more_imports": 0.05,
}
#: Ends of a session that the agent didn't choose.
UNCLEAN_ENDS = ["user_killed", "max_turns", "error"]


def score(rows: DataFrame) -> DataFrame:
    """(session_id, score, label, commit, tests, ended, corrections, debt): SCORE_RULES over rows(session_id, status, tests_passed, session_end, corrections, files_created, complexity_delta, max_function_lines, biggest_file_growth, import_edges_delta).

    status is committed, reverted or uncommitted. Missing counts are 0; missing test results,
    ends and debt figures are told apart from bad ones as no_data.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    c = n("complexity_delta")
    found = {
        "committed": F.col("status") == "committed", "reverted": F.col("status") == "reverted", "tests_passed": F.col("tests_passed"), "tests_failed": ~F.col("tests_passed"),
        "unclean_end": F.col("session_end").isin(UNCLEAN_ENDS), "corrected": n("corrections") > 1, "no_more_complexity": c <= 0, "complexity_over_10": c > 10, "complexity_over_20": c > 20,
        "long_function": n("max_function_lines") > 100, "file_growth": n("biggest_file_growth") > 150, "new_files": (n("files_created") > 0) & (c <= 5), "more_imports": n("import_edges_delta") > 5, "no_more_imports": n("import_edges_delta") <= 0,
    }
    s = F.lit(0.5)
    for name, points in SCORE_RULES.items():
        s = s + F.when(F.coalesce(found[name], F.lit(False)), points).otherwise(0.0)
    s = T.round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 4)
    tests = F.when(F.col("tests_passed").isNull(), "no_data").when(F.col("tests_passed"), "passed").otherwise("failed")
    commit = F.when(F.col("status") == "uncommitted", "no_commit").otherwise(F.coalesce("status", F.lit("no_data")))
    debt = F.when((c == 0) & (n("import_edges_delta") == 0), "no_data").otherwise(F.concat_ws("/", c, n("max_function_lines"), n("biggest_file_growth"), n("import_edges_delta")))
    return rows.select("session_id", s.alias("score"), T.score_label(s).alias("label"), commit.alias("commit"), tests.alias("tests"), F.coalesce("session_end", F.lit("no_data")).alias("ended"), n("corrections").alias("corrections"), debt.alias("debt"))


def reverted_commits(commits: DataFrame) -> DataFrame:
    """(project, commit_id) of commits(project, commit_id, message) whose first seven digits a message of the project names behind the word Revert."""
    named = commits.select("project", F.explode(F.regexp_extract_all("message", F.lit(r"\b([0-9a-f]{7,40})\b"), F.lit(1))).alias("sha"), "message").where(F.col("message").contains("Revert"))
    return commits.select("project", "commit_id").join(named.select("project", F.substring("sha", 1, 7).alias("k")).distinct(), (F.substring(commits["commit_id"], 1, 7) == F.col("k")) & (commits["project"] == named["project"]), "left_semi")


def bind_in_window(sessions: DataFrame, commits: DataFrame, before_s: int = 60, after_s: int = 300) -> DataFrame:
    """(session_id, commit_id): each session's last commit from before_s seconds before its start to after_s after its end, in its project; commits marked `auto` only where there is no other.

    An interval join by hash: sessions are spread over the hours (long ones: months) that they
    and their margins touch, commits fall in one of each.
    """
    a, b = F.unix_seconds("started_at") - before_s, F.unix_seconds("completed_at") + after_s
    step = F.when(b - a <= 2 * DAY_S, HOUR_S).otherwise(30 * DAY_S)  # a session with a damaged time spans months, not half a million hours
    s = sessions.select("session_id", "project", a.alias("a"), b.alias("b"), step.alias("step")).where("a <= b")
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / F.col("step")), F.floor(F.col("b") / F.col("step")))))
    auto = F.col("auto") if "auto" in commits.columns else F.lit(False)
    c = commits.select("project", "commit_id", F.unix_seconds("at").alias("at"), auto.alias("auto")).withColumn("step", F.explode(F.array(F.lit(HOUR_S), F.lit(30 * DAY_S)))).withColumn("bucket", F.floor(F.col("at") / F.col("step")))
    hit = s.join(c, ["project", "step", "bucket"]).where("at between a and b")
    return hit.groupBy("session_id").agg(F.max(F.struct((~F.col("auto")).alias("by_hand"), "at", "commit_id")).alias("m")).select("session_id", "m.commit_id")


def nearest_session(commits: DataFrame, sessions: DataFrame, within_s: int = 1800) -> DataFrame:
    """(commit_id, session_id, gap_s): for each commit the session of its project that starts nearest in time, within the limit; ties by id.

    An as-of join without pairs: both sides fall into buckets of the limit's length, sessions
    into three of them; in a bucket each commit takes the last start before and the first after it.
    """
    s = sessions.select("project", "session_id", F.unix_seconds("started_at").alias("t")).where("t is not null").groupBy("project", "t").agg(F.min("session_id").alias("session_id"))
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("t") / within_s) + d)
    s = s.select("project", "t", F.struct("t", "session_id").alias("s"), F.lit(None).cast("string").alias("commit_id"), F.explode(around).alias("k"))
    c = commits.select("project", F.unix_seconds("at").alias("t"), "commit_id").where("t is not null and commit_id is not null").distinct()
    c = c.select("project", "t", F.lit(None).cast(s.schema["s"].dataType).alias("s"), "commit_id", F.floor(F.col("t") / within_s).alias("k"))
    w = W.partitionBy("project", "k").orderBy("t")  # equal times are peers, and a range frame holds them all
    both = s.unionByName(c).select("*", F.last("s", True).over(w.rangeBetween(W.unboundedPreceding, 0)).alias("below"), F.first("s", True).over(w.rangeBetween(0, W.unboundedFollowing)).alias("above"))
    near = both.where("commit_id is not null").select("commit_id", F.explode(F.array("below", "above")).alias("s"), "t").where("s is not null")
    near = near.select("commit_id", F.col("s.session_id").alias("session_id"), F.abs(F.col("t") - F.col("s.t")).alias("gap_s")).where(F.col("gap_s") < within_s)
    return near.groupBy("commit_id").agg(F.min(F.struct("gap_s", "session_id")).alias("m")).select("commit_id", "m.session_id", "m.gap_s")


def debounce(events: DataFrame) -> DataFrame:
    """Events(session, path, at, event_id, hash) whose hash differs from the one before of the same session and path; A-B-A fires again."""
    w = W.partitionBy("session", "path").orderBy("at", "event_id")
    return events.withColumn("prev", F.lag("hash").over(w)).where(~F.col("hash").eqNullSafe(F.col("prev")) | F.col("prev").isNull()).drop("prev")


def verdict(events: DataFrame) -> DataFrame:
    """Per session FAIL (errors), WARN (writes without any check) or PASS."""
    g = events.groupBy("session").agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "write").alias("writes"), F.count_if(F.col("kind") == "check").alias("checks"))
    v = F.when(F.col("errors") > 0, "FAIL").when((F.col("writes") > 0) & (F.col("checks") == 0), "WARN").otherwise("PASS")
    return g.select("session", "errors", "writes", "checks", v.alias("verdict"))


def suppress_seen(shown: DataFrame, threshold: int = 10) -> DataFrame:
    """(unit, call, suppressed): a unit shown again within `threshold` calls of its last unsuppressed showing is suppressed.

    Suppressed showings don't count as seen, so the state runs along each unit's calls; it is
    kept over sorted partitions, batch by batch, and never holds a unit's calls together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, seen = None, None
        for b in batches:
            out = []
            for u, c in zip(b["unit"], b["call"]):
                if u != unit:
                    unit, seen = u, None
                hide = seen is not None and (c + 1) - seen < threshold
                out.append(hide)
                if not hide:
                    seen = c
            yield b.assign(suppressed=out)

    rows = shown.where("unit is not null").select("unit", F.col("call").cast("long").alias("call"))
    return rows.repartition("unit").sortWithinPartitions("unit", "call").mapInPandas(run, "unit string, call long, suppressed boolean")


def merge_insights(insights: DataFrame) -> DataFrame:
    """(target, description, occurrences, turns, priority): insights of one target whose texts are alike (ratio over 0.8) become one.

    Order-dependent by nature: within a target the insights are taken in order of id, and each
    joins the first kept one that it resembles. Exact repeats are folded before, so a target
    with many equal rows costs one.
    """
    from difflib import SequenceMatcher

    folded = insights.where("target is not null").groupBy("target", F.lower("description").alias("text")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.sum("turns").alias("turns"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        match = SequenceMatcher(None)
        for row in group.sort_values("id").itertuples():
            match.set_seq2(row.text or "")
            for k in kept:
                match.set_seq1(k[1] or "")
                # the two quick ratios are upper bounds
                if row.text and k[1] and match.real_quick_ratio() > 0.8 and match.quick_ratio() > 0.8 and match.ratio() > 0.8:
                    k[2] += row.n
                    k[3] += row.turns
                    break
            else:
                kept.append([row.target, row.text, row.n, row.turns])
        rows = [(t, d, int(n), int(x), "high" if n >= 3 else "medium" if n >= 2 else "low") for t, d, n, x in kept]
        return pd.DataFrame(rows, columns=["target", "description", "occurrences", "turns", "priority"])

    return folded.groupBy("target").applyInPandas(run, "target string, description string, occurrences long, turns long, priority string")
