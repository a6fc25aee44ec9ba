"""Every query with SQL against DuckDB; the others run and have rows."""

import pytest

from blockloom import catalog
from tests.duck import SF, connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = spark_rows(catalog.QUERIES[name](spark, SF))
    if name in catalog.SQL:
        assert got == duck_rows(connect(), catalog.SQL[name])
    if name not in ("rerank", "retrieval_bypass"):
        assert got[1]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"content_id", "doc_id", "n_blocks"} <= set(e.entry(spark).columns)
