"""Search and ranking: intents, targets, dictionary matches, vectors.

Null and empty texts have no tokens and match nothing; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T

# Words that tell what an intent wants, stemmed before they are compared.
CREATE = ["add", "create", "implement", "new", "build", "introduce", "write"]
CHANGE = [
    "move", "merge", "consolidate", "combine", "split", "extract", "reorganize", "relocate", "flatten", "group", "change", "refactor", "simplify", "rename",
    "remove", "delete", "optimize", "replace", "rewrite", "extend", "modify", "update", "fix", "adjust",
]
# Verdict thresholds of a vector search.
HARD, FLOOR, GAP = 0.55, 0.45, 0.05
ROWS, QUERIES = 8192, 1024  # vectors and queries of a block


def intent_search(functions: DataFrame, callers: DataFrame, intent: str, least: float = 0.2, most: int = 5) -> DataFrame:
    """(fn_id, score, callers): functions by token overlap with an intent: name 0.5, signature 0.3, stored intent 0.4, a tenth more from 3 callers on.

    The query's tokens are literals of the plan; the top `most` are taken without a full sort.
    """
    q = F.array_distinct(T.tokenize(F.lit(intent)))
    rows = functions.select("fn_id", "fn_name", "params", "return_type", "docstring", "intent").join(callers, "fn_id", "left").fillna(0, ["callers"]).withColumn("q", q).where(F.size("q") > 0)
    share = lambda c: F.size(F.array_intersect("q", c)) / F.size("q")
    raw = share(T.name_stems(F.col("fn_name"))) * 0.5 + share(T.function_tokens(F.col("fn_name"), F.col("params"), F.col("return_type"), F.col("docstring"))) * 0.3 + share(F.array_distinct(T.tokenize(F.col("intent")))) * 0.4
    score = F.when(F.col("callers") >= 3, raw * 1.1).otherwise(raw)
    return rows.withColumn("s", score).where(F.col("s") >= least).select("fn_id", T.round_half_up(F.col("s"), 3).alias("score"), "callers").orderBy(F.desc("score"), "fn_id").limit(most)


def reuse_suggestions(hits: DataFrame, functions: DataFrame, edges: DataFrame, intent: str) -> DataFrame:
    """(fn_id, upstream, params): of found functions(fn_id) the callers that have a parameter the intent speaks of, which may be called with other arguments instead; params are the shared stems."""
    q = F.array_distinct(T.tokenize(F.lit(intent)))
    up = edges.select(F.col("target_fn").alias("fn_id"), F.col("source_fn").alias("upstream")).distinct().join(hits.select("fn_id"), "fn_id")
    names = F.flatten(F.transform("params", lambda p: T.split_identifier(p["name"])))
    p = functions.select(F.col("fn_id").alias("upstream"), F.array_distinct(F.transform(names, T.stem)).alias("stems"))
    shared = F.array_sort(F.array_intersect("stems", q))
    return up.join(p, "upstream").select("fn_id", "upstream", F.array_join(shared, ",").alias("params")).where("params <> ''")


def intent_category(c: Column) -> Column:
    """change, create or unknown by the stems of a text; change goes first."""
    words = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z]+)"), F.lit(1))), T.stem)
    stems = lambda ws: F.transform(F.array(*[F.lit(w) for w in ws]), T.stem)
    return F.when(F.arrays_overlap(words, stems(CHANGE)), "change").when(F.arrays_overlap(words, stems(CREATE)), "create").otherwise("unknown")


def explicit_paths(c: Column) -> Column:
    """Source paths written out in a text, in order and once each."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z0-9_./-]+\.(?:py|ts|js|java|go|rs|cs))"), F.lit(1))
    return F.array_distinct(found)


def dictionary_matches(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name): names(name) standing in docs(doc_id, text) as whole words.

    The texts are cut into words once and joined by hash on the word, so no text meets every
    name; names shorter than 4 letters are left out.
    """
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("name"))
    return words.join(names.where(F.length("name") >= 4).select("name").distinct(), "name").select("doc_id", "name")


def dot(a: str, b: str) -> Column:
    """Inner product of two float arrays in double precision, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, query: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id, score): the k rows of vectors(vec_id, embedding) with the largest inner product with the one row of query(q)."""
    hits = vectors.crossJoin(F.broadcast(query.limit(1))).select("vec_id", T.round_half_up(dot("embedding", "q"), 4).alias("score"))
    return hits.orderBy(F.desc("score"), "vec_id").limit(k)


def _meet(k: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        rows, asked = block[block["member"]], block[~block["member"]]
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        score = np.floor(np.vstack(asked["embedding"]) @ np.vstack(rows["embedding"]).T * 10_000 + 0.5) / 10_000
        ids, q = rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        score[q[:, None] == ids[None, :]] = -np.inf
        best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(q, best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(score, best, axis=1).ravel()})
        return out[out["query_id"] != out["vec_id"]]

    return run


def vector_topk_each(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score): for every row of queries(vec_id, embedding) the k other rows of vectors with the largest inner product, ties by vec_id.

    Blocks of queries meet blocks of vectors, so no task holds either whole. Rows without id or vector take no part.
    """
    usable = lambda d: d.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows, asked = usable(vectors), usable(queries)
    a, b = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // QUERIES))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = rows.select("*", F.lit(True).alias("member"), mine(a).alias("a"), every(b).alias("b")).unionByName(asked.select("*", F.lit(False).alias("member"), every(a).alias("a"), mine(b).alias("b")))
    found = blocks.groupBy("a", "b").applyInPandas(_meet(k), "query_id long, vec_id long, score double")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.negative("score").alias("d"), "vec_id"))), 1, k).alias("t")).select("query_id", F.explode("t").alias("x"))
    return top.select("query_id", F.col("x.vec_id").alias("vec_id"), F.negative("x.d").alias("score"))


def vector_verdict(top: DataFrame, *keys: str) -> DataFrame:
    """One row (per keys): verdict and confidence of a top-k result by its best score and the gap to the last."""
    s = top.groupBy(*keys).agg(F.max("score").alias("best"), F.min("score").alias("last"))
    ok = (F.col("best") >= HARD) | ((F.col("best") >= FLOOR) & (F.col("best") - F.col("last") >= GAP))
    return s.select(*keys, F.when(ok, "OK").otherwise("NO_CLEAR_MATCH").alias("verdict"), F.when(F.col("best") >= HARD, "high").when(ok, "medium").otherwise("low").alias("confidence"), "best")
