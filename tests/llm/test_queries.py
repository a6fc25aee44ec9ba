"""Every query with SQL against DuckDB; the others' rows and columns."""

import pytest

from blockloom.llm import registry
from tests.duck import SF, connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(spark, name):
    got, want = spark_rows(registry.QUERIES[name](spark, SF)), duck_rows(connect(), registry.SQL[name])
    assert got[0] == want[0] and got[1] == want[1] and got[1]


@pytest.mark.parametrize("name", ["op2_tokens", "op5_quality", "op6_pii", "op8_simhash", "op10_toxicity", "op12_language"])
def test_one_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in registry.QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
