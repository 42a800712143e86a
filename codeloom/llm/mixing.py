"""Mixing sources to target weights.

Method: tokens are added up per source, repetition rates are derived from them, and each
document is emitted floor(rate) times plus once more if its hash-seeded Bernoulli draw, with
the rate's fraction as probability, says so.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import Scratch

#: Vocabulary of the tokenizer that sizes are counted with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts a text before byte pairs are merged, as this vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEED = 42


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of docs(doc_id, source, text); null texts have no tokens, and rows without source are left out."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    with open(vocabulary, "rb") as f:
        sent = sc.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encode = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield batch[["doc_id", "source"]].assign(tokens=[len(encode(t)) if t else 0 for t in batch["text"]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim("source").alias("source"), "text").where("doc_id is not null and source <> ''")
    return rows.mapInPandas(run, "doc_id long, source string, tokens long")


def repetition_rates(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, rate) for every source of targets.

    The size aimed at is that of all counted documents. rate = share of it over what the source
    has, at most max_repeats; 0 for sources without tokens; targets without a source are left out.
    """
    have = counts.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    size = have.agg(F.sum("available_tokens").alias("size"))
    rows = targets.select(F.trim("source").alias("source"), "target_share", "max_repeats").where("source <> ''").join(have, "source", "left").crossJoin(size)
    wish = F.coalesce(F.try_divide(F.col("target_share") * F.col("size"), F.col("available_tokens")), F.lit(0.0))
    return rows.select("source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.least(wish, F.col("max_repeats").cast("double")).alias("rate"))


def uses(rate: Column, seed: int = SEED) -> Column:
    """How often a document is emitted: floor(rate) and one Bernoulli copy drawn from its doc_id."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): mix(doc_id, source, copy_no, tokens) and shares(source, target_share, max_repeats, available_tokens, rate, mixed_tokens, mixed_share).

    targets(source, target_share, max_repeats) has one row per source, so it is small by
    nature; it is joined by shuffle or broadcast as its size decides. Sources without target
    give no rows, and an empty corpus an empty mix with zero shares.
    """
    tmp = Scratch(docs.sparkSession, "mixing")
    counts = tmp.save(token_counts(docs, vocabulary), "counts")
    rates = tmp.save(repetition_rates(counts, targets), "rates")
    used = counts.join(rates.select("source", "rate"), "source").withColumn("uses", uses(F.col("rate"), seed))
    mixed = used.where("uses > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"), "tokens")
    sums = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"))
    total = sums.agg(F.sum("mixed_tokens").alias("all"))
    got = F.coalesce("mixed_tokens", F.lit(0))
    shares = rates.join(sums, "source", "left").crossJoin(total).select("source", "target_share", "max_repeats", "available_tokens", "rate", got.alias("mixed_tokens"), F.coalesce(F.try_divide(got, F.col("all")), F.lit(0.0)).alias("mixed_share"))
    return mixed, shares


def _inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/mix_sources.parquet")


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mix(*_inputs(spark, root))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mix(*_inputs(spark, root))[1]
