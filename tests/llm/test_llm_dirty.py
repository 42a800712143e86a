"""Every registered query over empty tables and over tables with all-null rows."""

import pytest

pytest.importorskip("pyarrow")
from codeloom.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_queries_survive(spark, dirty, kind):
    for name, query in QUERIES.items():
        n = query(spark, dirty[kind]).count()
        assert n == 0 or kind == "nulls", name
