"""Queries whose context ends just at its limit on a page behind a blank one, against DuckDB."""

import duckdb
import pytest

from blockloom import catalog
from tests.duck import duck_rows, spark_rows


@pytest.mark.parametrize("name", ["page_context", "multimodal_pipeline", "multimodal_graph", "multimodal_nodes"])
def test_page_at_the_limit_behind_a_blank_one(spark, tmp_path, name):
    """The first page has lines of spaces alone (shorter ones are headings); the second one's first four texts, joined, have 1,999 to 2,002 characters."""
    line = lambda n: ("Alpha beta. " * 50)[: n - 1] + "x"
    texts = [(k, "\n".join([" " * 20] * 10 + ["Gamma table", line(499), line(499), line(499), line(499 + k), line(60), "Delta image", "Zeta table", line(70), "Epsilon"])) for k in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(catalog.QUERIES[name](spark, str(tmp_path))) == duck_rows(con, catalog.SQL[name])
