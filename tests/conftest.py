"""One local session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("driver tables are absent")
    return DATA


@pytest.fixture(scope="session")
def dirty(data, tmp_path_factory):
    """Folders with the driver's tables emptied, and with all-null rows added to a few of theirs."""
    import glob

    import pyarrow as pa
    import pyarrow.parquet as pq

    out = {}
    for kind in ("empty", "nulls"):
        folder = tmp_path_factory.mktemp(kind)
        for p in glob.glob(f"{data}/*.parquet"):
            t = pq.read_table(p)
            n = pa.table({c: pa.nulls(5, t.schema.field(c).type) for c in t.column_names})
            pq.write_table(t.slice(0, 0) if kind == "empty" else pa.concat_tables([t.slice(0, 30).cast(n.schema), n]), folder / os.path.basename(p))
        out[kind] = str(folder)
    return out
