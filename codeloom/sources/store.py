"""Written graphs and version control as sources and sinks."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GRAPH_JSON = """files map<string, struct<path:string,language:string,imports:array<map<string,string>>,function_ids:array<string>,lines_of_code:int,zone:string,source_hash:string>>,
functions map<string, struct<id:string,file:string,name:string,kind:string,language:string,line_start:int,line_end:int,return_type:string,docstring:string,complexity:int,lines:int,intent:string,class_name:string>>,
call_edges array<struct<source_fn:string,target_fn:string,confidence:double,call_site:struct<file:string,line:int,expression:string>>>,
import_edges array<struct<source_file:string,target_file:string,names:array<string>>>"""


def read_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """functions, files, edges and imports of a graph stored as one JSON document; absent parts are empty."""
    doc = spark.read.schema(GRAPH_JSON).option("multiLine", "true").json(path)
    return {
        "functions": doc.select(F.explode(F.map_values("functions")).alias("x")).select("x.*"),
        "files": doc.select(F.explode(F.map_values("files")).alias("x")).select("x.*"),
        "edges": doc.select(F.explode("call_edges").alias("x")).select("x.source_fn", "x.target_fn", F.col("x.call_site.file").alias("site_file"), F.col("x.call_site.line").alias("line"), F.col("x.call_site.expression").alias("expression"), "x.confidence"),
        "imports": doc.select(F.explode("import_edges").alias("x")).select("x.*"),
    }


def write_graph(tables: dict[str, DataFrame], path: str, snapshot: str | None = None) -> None:
    """Write graph tables as parquet; with a snapshot, as one partition of a history."""
    for name, df in tables.items():
        if snapshot is None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts").parquet(f"{path}/{name}") if "snapshot_ts" in df.columns else df.withColumn("snapshot_ts", F.lit(snapshot)).write.mode("append").partitionBy("snapshot_ts").parquet(f"{path}/{name}")


class GitLog(DataSource):
    """Commits of a repository and the files they touch: spark.read.format("git_log").option("path", folder).

    Options: path, last (commits, default 20). Columns sha, author, commit_date, message, file.
    A folder without version control gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "sha string, author string, commit_date string, message string, file string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.last = options.get("path", "."), int(options.get("last", 20))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        out = subprocess.run(["git", "-C", self.path, "log", f"-{self.last}", "--name-only", "--date=short", "--format=%x1e%h%x1f%an%x1f%ad%x1f%s"], capture_output=True, text=True)
        for block in out.stdout.split("\x1e")[1:]:
            head, *files = block.strip().split("\n")
            for f in files:
                if f.strip():
                    yield (*head.split("\x1f"), f.strip())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)
