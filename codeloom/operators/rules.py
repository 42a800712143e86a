"""Rules, lints, messages and small projections.

rules(id, category, title, content, source, affects array<string>); null arrays count as
empty, null keys match nothing, and empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources of rules that an audit may not remove.
PROTECTED = ["manual", "migrated-from-semantic"]


def _affects() -> Column:
    return F.coalesce("affects", F.array().cast("array<string>"))


def rules_for(rules: DataFrame, zone: str = "", file: str = "") -> DataFrame:
    """Rules whose affects name a zone as part of a text or a file exactly or by its end."""
    hit = F.lit(False)
    if zone:
        hit = hit | F.exists(_affects(), lambda a: F.contains(a, F.lit(zone)))
    if file:
        hit = hit | F.exists(_affects(), lambda a: (a == file) | F.endswith(F.lit(file), a))
    return rules.where(hit)


def coherence(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, id): written files and the rules that name them, by equality or by end of path; joined by hash on the last part of the path."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    r = rules.select("id", F.explode(_affects()).alias("a")).withColumn("k", last(F.col("a")))
    return files.select("path", last(F.col("path")).alias("k")).join(r, "k").where("path = a or endswith(path, concat('/', a))").select("path", "id").distinct()


def apply_audit(rules: DataFrame, add: DataFrame, update: DataFrame, remove: DataFrame) -> DataFrame:
    """rules after an audit: given texts replace old ones unless blank, removals spare protected sources, additions get the next ids in order of title."""
    u = update.select("id", F.col("title").alias("t2"), F.col("content").alias("c2"))
    kept = rules.join(remove.select("id", F.lit(True).alias("gone")), "id", "left").where(F.col("gone").isNull() | F.col("source").isin(PROTECTED)).drop("gone")
    filled = lambda new, old: F.coalesce(F.when(F.trim(new) != "", F.col(new)), F.col(old))
    kept = kept.join(u, "id", "left").select("id", "category", filled("t2", "title").alias("title"), filled("c2", "content").alias("content"), "source", "affects")
    from pyspark.sql import Window as W

    top = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = add.withColumn("n", F.row_number().over(W.orderBy("title"))).crossJoin(top)  # additions of one audit: a handful
    return kept.unionByName(fresh.select((F.col("top") + F.col("n")).cast(rules.schema["id"].dataType).alias("id"), "category", "title", "content", "source", "affects"))


def dismissed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of dismissed (category, title), each once at its earliest date."""
    return old.unionByName(new).groupBy("category", "title").agg(F.min("dismissed_at").alias("dismissed_at"))


def task_lint(c: Column, top_score: Column | None = None) -> Column:
    """Warnings on a task text: under three words, several tasks in one and, where the best score of a search for it is given, one under 0.5 as unclear."""
    words = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    verbs = F.size(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b(add|fix|change|remove|rename|update|move|split|merge|create|write)\b"), F.lit(1)))
    several = F.lower(c).rlike(r"\band\b|&") & (verbs >= 2)
    unclear = F.lit(False) if top_score is None else F.coalesce(top_score < 0.5, F.lit(False))
    return F.filter(F.array(F.when(F.size(words) < 3, F.lit("short")), F.when(several, F.lit("several")), F.when(unclear, F.lit("unclear"))), lambda x: x.isNotNull())


def commit_message(c: Column, ticket: str = r"[A-Z]{2,}-\d+", template: str = "{ticket}: {message}") -> Column:
    """A message in the template's form: the ticket is taken out of it, a prefix like feat(T-1): unwrapped; without ticket the plain message."""
    key = F.regexp_extract(c, f"({ticket})", 1)
    body = F.regexp_replace(c, r"^\s*\w+\([^)]*\)!?:\s*|^\s*(?:feat|fix|chore|docs|refactor|test)!?:\s*", "")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, f"\\[?{ticket}\\]?:?", " "), r"\s+", " "))
    filled = F.replace(F.replace(F.lit(template), F.lit("{ticket}"), key), F.lit("{message}"), body)
    return F.when(key == "", body).otherwise(filled)


def clean_report(reports: DataFrame) -> DataFrame:
    """Generated reports brought into their bounds: risk level one of low, medium, high, score within 0..1, texts cut to 500."""
    level = F.when(F.lower("risk_level").isin("low", "medium", "high"), F.lower("risk_level")).otherwise("medium")
    return reports.withColumns({"risk_level": level, "risk_score": F.least(F.greatest(F.coalesce(F.when(~F.isnan("risk_score"), F.col("risk_score")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), "summary": F.substring("summary", 1, 500)})


def hash_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a text encoder: hashed word counts of unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def encode(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(id, vec) of rows(id, text) by any encoder of lists of texts, which each Python worker gets once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"], "vec": list(encoder(part["text"].tolist()))})

    return rows.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, vec array<float>")


def graph_projection(functions: DataFrame, edges: DataFrame, files: DataFrame, zone: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of one zone for drawing: functions with callers and whether they are locked, and the calls with both ends in the zone."""
    inside = files.where(F.col("zone_name") == zone).select(F.col("path").alias("file"))
    f = functions.select("fn_id", "file", "fn_name").join(inside, "file", "left_semi")
    n = edges.groupBy(F.col("target_fn").alias("fn_id")).agg(F.count(F.lit(1)).alias("callers"))
    nodes = f.join(n, "fn_id", "left").fillna(0, ["callers"]).select("fn_id", "fn_name", "callers", (F.col("callers") > 0).alias("locked"))
    ids = f.select("fn_id")
    links = edges.select("source_fn", "target_fn").distinct().join(ids.withColumnRenamed("fn_id", "source_fn"), "source_fn", "left_semi").join(ids.withColumnRenamed("fn_id", "target_fn"), "target_fn", "left_semi")
    return nodes, links.select("source_fn", "target_fn")
