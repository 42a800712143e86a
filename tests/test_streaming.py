"""Streaming twins over parquet files."""

from datetime import datetime, timedelta

from codeloom.streaming import events as E


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    q.stop()
    return stream.sparkSession.sql(f"select * from {name}").collect()


def source(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_debounce_keeps_state_between_batches(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [[(1, "p", t, "A"), (1, "p", t + timedelta(seconds=1), "A")], [(1, "p", t + timedelta(seconds=2), "A"), (1, "p", t + timedelta(seconds=3), "B")], [(1, "p", t + timedelta(seconds=4), "A"), (2, "p", t, "A")]]
    got = run(E.debounce(source(spark, tmp_path / "in", rows, "session long, path string, at timestamp, hash string")), "debounced")
    assert sorted((r.session, r.hash) for r in got) == [(1, "A"), (1, "A"), (1, "B"), (2, "A")]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [[(t, "a", 1.0), (t + timedelta(minutes=1), "a", 2.0)], [(t + timedelta(hours=1), "a", 4.0)], [(t + timedelta(hours=2), "a", 8.0)]]
    got = run(E.windows(source(spark, tmp_path / "in", rows, "at timestamp, kind string, value double")), "windowed")
    assert (t, 2, 3.0) in {(r.start, r.n, r.total) for r in got}


def test_session_totals(spark, tmp_path):
    got = run(E.session_totals(source(spark, tmp_path / "in", [[(1, "error"), (1, "write")], [(1, "write")]], "session long, kind string")), "totals", "complete")
    assert [(r.errors, r.writes, r.checks) for r in got] == [(1, 2, 0)]
