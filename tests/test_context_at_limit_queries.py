"""Queries whose context ends just at its limit, against DuckDB."""

import duckdb
import pytest

from blockloom import catalog
from tests.duck import duck_rows, spark_rows


@pytest.mark.parametrize("name", ["page_context", "page_context_in_rows", "multimodal_pipeline", "multimodal_graph", "multimodal_nodes"])
def test_texts_of_just_the_limit_before_another(spark, tmp_path, name):
    """The first four text lines of a page, joined, have 1,999 to 2,002 characters; the limit is 2,000 and more text follows."""
    line = lambda n: ("Alpha beta. " * 50)[: n - 1] + "x"
    texts = [(k, "\n".join([line(499), line(499), line(499), "Gamma table", line(499 + k), "Delta image", "Epsilon", line(60), line(70), line(80)])) for k in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(catalog.QUERIES[name](spark, str(tmp_path))) == duck_rows(con, catalog.SQL[name])
