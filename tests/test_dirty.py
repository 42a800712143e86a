"""Every core query over empty tables and over tables with all-null rows."""

import pytest

from codeloom.plans.catalogue import QUERIES


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_queries_survive(spark, dirty, kind):
    for name, query in QUERIES.items():
        assert query(spark, dirty[kind]).count() >= 0, name


def test_clashing_extra_columns_are_ignored(spark):
    from pyspark.sql import functions as F

    from codeloom.operators import graph as G

    f = spark.createDataFrame([("a::f", "p", "a", "f", None)], "fn_id string, project string, file string, fn_name string, route string").withColumns({"callers": F.lit("x"), "zone": F.lit("y"), "n": F.lit(1)})
    e = spark.createDataFrame([("a::f", "a::f")], "source_fn string, target_fn string").withColumns({"fn_id": F.lit("x"), "callers": F.lit(2)})
    p = spark.createDataFrame([("a", "core")], "path string, zone_name string").withColumns({"file": F.lit("x"), "zone": F.lit("z")})
    assert [tuple(r) for r in G.zone_map(f, e, p).collect()] == [("core", 1, 1, 0, 1)]
    assert G.hotspots(f, e).first().callers == 1
    assert [r.callers for r in G.median_function(f, e).collect()] == [1]
