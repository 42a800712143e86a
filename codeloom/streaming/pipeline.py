"""The write pipeline: files written by an agent bring the stored graph up to date and yield warnings.

A micro-batch holds writes(session, path, project, prog_lang, content, at). Each batch writes
its results below a folder by its number, so that a batch that is run again after a failure
replaces what it wrote before. The stored graph is the fold of these folders: the newest batch
that has a file holds all its functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators import incremental as I
from codeloom.operators import tools
from codeloom.sources import facts

_FUNCTIONS = facts.FUNCTIONS + ", fn_id string, source_hash string, batch long"


def stored_functions(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The functions of every file as its newest batch (before batch `before`) left them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/functions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _FUNCTIONS)
    rows = spark.read.schema(_FUNCTIONS).option("recursiveFileLookup", "true").parquet(f"{store}/functions")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"]).where("fn_name is not null")


def write_step(store: str, edges: DataFrame):
    """A foreachBatch function that updates the store and appends to its warnings; edges(source_fn, target_fn) tell who calls what."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.where("path is not null and content is not null").withColumn("n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("at"))))
        files = last.where("n = 1").select("path", "prog_lang", "content", F.sha2("content", 256).alias("source_hash"))
        old = stored_functions(spark, store, number)
        known = old.select("path", "source_hash").distinct()
        files = files.join(known, ["path", "source_hash"], "left_anti")  # an unchanged file is skipped
        fresh = facts.functions(files).withColumn("fn_id", F.concat("path", F.lit("::"), "fn_name"))
        rows = files.select("path", "source_hash").join(fresh, "path", "left").withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").parquet(f"{store}/functions/b{number}")
        before = old.join(files.select("path"), "path", "left_semi").select("fn_id", "params", "return_type")
        after = spark.read.schema(_FUNCTIONS).parquet(f"{store}/functions/b{number}").where("fn_name is not null").select("fn_id", "params", "return_type")
        callers = edges.groupBy(F.col("target_fn").alias("fn_id")).agg(F.count(F.lit(1)).alias("callers"))
        changes = I.signature_diff(before, after, callers)
        none = spark.createDataFrame([], "path string, added string, removed string")
        tools.impact_check(changes, none).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{store}/warnings/b{number}")

    return step


def run_writes(writes: DataFrame, store: str, edges: DataFrame, checkpoint: str):
    """Start the pipeline over a stream of writes."""
    return writes.writeStream.foreachBatch(write_step(store, edges)).option("checkpointLocation", checkpoint).start()


def hook_log(lines: DataFrame) -> DataFrame:
    """(event, outcome, n, average_ms, longest_ms) of a log(event, outcome, duration_ms), as a stream or a table."""
    return lines.groupBy("event", "outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("average_ms"), F.max("duration_ms").alias("longest_ms"))
