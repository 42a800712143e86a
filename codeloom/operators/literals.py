"""Shared literal values: couplings, value collections, occurrences, budgets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.ordering import running_sum

# Values too common to couple anything.
GENERIC = ["0", "1", "0.0", "1.0", "-1", "True", "False", "None", "null", "", "id", "name", "type", "value", "key"]

# Fixed value: what a bare number looks like.
BARE_NUMBER = r"^-?\d+(\.\d+)?$|^-?\.\d+$"


def artifact_hits(units: DataFrame) -> DataFrame:
    """(unit_id, file, kind, value): usable artifact values of units by their first file; lists count as sorted text, bare numbers and generic values don't count."""
    a = units.where(F.size("source_files") > 0).select(F.col("id").alias("unit_id"), F.col("source_files")[0].alias("file"), F.explode("hardcoded_artifacts").alias("a"))
    value = F.coalesce("a.value", F.array_join(F.array_sort("a.value_list"), ","))
    rows = a.select("unit_id", "file", F.col("a.kind").alias("kind"), value.alias("value"), F.coalesce("a.surface", F.lit("")).alias("surface"))
    bare = F.col("value").rlike(BARE_NUMBER) & (F.col("surface") == "")
    return rows.where(F.col("value").isNotNull() & ~F.col("value").isin(GENERIC) & ~bare).drop("surface")


def couplings(hits: DataFrame, least_hits: int = 2, least_files: int = 2) -> DataFrame:
    """(value, hits, files, primary_kind, kind_uniformity, coupling_id): values found at several places in several files; the commonest kind (ties by name) and its share of the hits."""
    by_kind = hits.groupBy("value", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = by_kind.groupBy("value").agg(F.min(F.struct(F.negative("n").alias("m"), "kind")).alias("k")).select("value", F.col("k.kind").alias("primary_kind"), F.negative("k.m").alias("n"))
    g = hits.groupBy("value").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("file").alias("files")).where((F.col("hits") >= least_hits) & (F.col("files") >= least_files))
    share = T.round_half_up(F.col("n") / F.col("hits"), 2)
    return g.join(top, "value").select("value", "hits", "files", "primary_kind", share.alias("kind_uniformity"), F.substring(F.sha2("value", 256), 1, 8).alias("coupling_id"))


def literal_uses(edges: DataFrame) -> DataFrame:
    """(source_fn, target_fn, literal): quoted strings in the expressions of calls."""
    lits = F.regexp_extract_all("expression", F.lit('"([^"\\\\\\n]*)"'), F.lit(1))
    return edges.select("source_fn", "target_fn", F.explode(lits).alias("literal"))


def value_histogram(units: DataFrame, uses: DataFrame) -> DataFrame:
    """(unit_id, value, uses): how often each value of a value unit stands in calls of the whole graph; unused values have 0."""
    v = units.where("kind = 'value_unit'").select(F.col("id").alias("unit_id"), F.explode("value_items").alias("value")).distinct()
    n = uses.groupBy(F.col("literal").alias("value")).agg(F.count(F.lit(1)).alias("uses"))
    return v.join(n, "value", "left").fillna(0, ["uses"]).select("unit_id", "value", "uses")


def value_consumers(uses: DataFrame) -> DataFrame:
    """Per literal: uses, calling functions and their files."""
    return uses.groupBy("literal").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("source_fn").alias("functions"), F.count_distinct(F.split_part("source_fn", F.lit("::"), F.lit(1))).alias("files"))


def literal_occurrences(docs: DataFrame, values: list[str], most: int = 50) -> DataFrame:
    """(value, doc_id, line, hits): lines of documents that hold a value as a whole word (no letter, digit or underscore beside it), the first `most` per value by document and line.

    Values are taken literally, whatever marks they hold; no values or only empty ones give no rows.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "content"))
    quoted = "|".join(re.escape(v) for v in sorted(set(values), key=lambda v: (-len(v), v)) if v) or "(?!)"
    words = lines.select("doc_id", "line", F.explode(F.regexp_extract_all("content", F.lit(r"(?<![A-Za-z0-9_])(" + quoted + r")(?![A-Za-z0-9_])"), F.lit(1))).alias("value"))
    n = words.groupBy("value", "doc_id", "line").agg(F.count(F.lit(1)).alias("hits"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("value").orderBy("doc_id", "line"))).where(F.col("r") <= most).drop("r")


def budgeted_prefix(rows: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """The first rows of each key, in order, whose sizes add up to no more than the budget."""
    return running_sum(rows, key, [F.col(c) for c in order], size, "used").where(F.col("used") <= budget)
