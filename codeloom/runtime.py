"""Session helpers shared by all operators: table reading and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One driver table; a file or a directory of part files."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir, which every executor can reach.

    Where it is unset on a local master (tests) a temporary folder is created and stored in
    the session, so that all operators of one session use the same. On any other master an
    unset folder is an error, since a machine-local one would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(spark.sparkContext, "_codeloom_dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="codeloom-")
            spark.sparkContext._codeloom_dir = folder
    return folder.rstrip("/")


class Scratch:
    """Written intermediate tables of one operator run, below the shared folder.

    `save` writes a DataFrame as parquet and reads it back, which cuts its lineage and lets
    a lost executor's work be read again instead of recomputed. An operator gives up the tables
    that its result doesn't read with keep_only; the rest stay until clear_scratch is called.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._written: list[tuple[str, str]] = []
        if not hasattr(spark.sparkContext, "_codeloom_scratch"):
            spark.sparkContext._codeloom_scratch = []
        spark.sparkContext._codeloom_scratch.append(self.root)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}_{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        where = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        self._written.append((name, where))
        return self.spark.read.schema(df.schema).parquet(where)

    def keep_only(self, *names: str) -> None:
        """Delete the tables written so far but those saved under the given names."""
        for name, where in self._written:
            if name not in names:
                _delete(self.spark, where)
        self._written = [x for x in self._written if x[0] in names]


def _delete(spark: SparkSession, where: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables that this session wrote, once no result that reads them is needed."""
    roots = getattr(spark.sparkContext, "_codeloom_scratch", [])
    for where in roots:
        _delete(spark, where)
    roots.clear()
