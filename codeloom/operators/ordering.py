"""Places and running sums within keys that may hold any part of the rows.

A window over a key brings the key into one task. Here the rows are sorted by range over the
whole cluster instead; each sorted partition numbers its own rows, and the sizes of the
partitions before it, one row per key and partition, are added. Null keys are a key of their
own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.runtime import Scratch


def _ranged(rows: DataFrame, key: str, order: list[Column], label: str) -> DataFrame:
    by = [F.col(key), *order]
    cut = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return Scratch(rows.sparkSession, label).save(cut.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "ranged")


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 1 within their key, in an order that tells all rows of a key apart."""
    r = _ranged(rows, key, order, "numbered")
    sizes = r.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_from"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "_from", before.alias("_before"))
    j = r.join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return j.select(*rows.columns, (F.col("_before") + F.col("_seq") - F.col("_from") + 1).cast("int").alias(name))


def running_sum(rows: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows of their key up to themselves; nulls count as 0."""
    r = _ranged(rows.withColumn("_v", F.coalesce(F.col(value), F.lit(0))), key, order, "sums")
    sums = r.groupBy(key, "_part").agg(F.sum("_v").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), before.alias("_before"))
    own = F.sum("_v").over(W.partitionBy(key, "_part").orderBy("_seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    j = r.withColumn("_own", own).join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return j.select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))
