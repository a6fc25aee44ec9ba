"""Pages that share an address, or have none, as files that a stream lists."""

import duckdb

from blockloom import catalog
from tests.duck import duck_rows, spark_rows


def test_pages_of_one_address_keep_their_own_times(spark, tmp_path):
    rows = [(1, "http://a/1", "x\ny"), (3, "http://a/1", "z"), (5, "http://a/1", None), (6, "http://b/", ""), (7, "http://b/", "q\n"), (10, None, "n"), (11, None, "m")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert spark_rows(catalog.QUERIES["incremental_files"](spark, str(tmp_path))) == duck_rows(con, catalog.SQL["incremental_files"])
