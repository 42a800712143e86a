"""Joins that survive keys holding a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1/HOT_PARTS of the rows; there are fewer than HOT_PARTS of them.
HOT_PARTS = 200


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS) -> list:
    """Keys holding more than 1/parts of the rows; fewer than `parts` by construction."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    hot = counts.orderBy(F.desc("_n")).limit(parts).crossJoin(F.broadcast(total)).where(F.col("_n") * parts > F.col("_all"))
    return [r[0] for r in hot.select(key).collect()]


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """left join right on `key`, where right has one row per key and `hot` are left's hot keys.

    The hot keys' rows of right (at most len(hot), so bounded) are broadcast; the rest is an
    ordinary shuffle join without any hot key. how: inner or left.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    many = left.where(~is_hot).join(right.where(~is_hot), key, how)
    return few.unionByName(many)
