"""References in HTML that were cut short."""

import duckdb
import pytest

from blockloom import catalog
from blockloom.sources.blocks import page_blocks
from tests.duck import duck_rows, spark_rows

PAGES = ["<h1>One &amp</h1><p>a &lt;b&gt; &amp;lt; &quot;c&#x27; d&am", "<p>x &lt y &ampz &</p><p>&&amp;& &gt", "<p>&quot;ende&quot</p>\n<li>&#x27;&#x2"]


@pytest.mark.parametrize("name", ["html_blocks", "dispatched_files", "parser_source"])
def test_reference_without_its_semicolon_is_text(spark, tmp_path, name):
    spark.createDataFrame([(4 * k, f"http://a/{k}", p) for k, p in enumerate(PAGES)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert spark_rows(catalog.QUERIES[name](spark, str(tmp_path))) == duck_rows(con, catalog.SQL[name])


def test_references_by_name_and_number_and_in_attributes():
    blocks = page_blocks('<p>&eacute;&#233;&#xE9; &copy &nosuch; &hellip;</p><img src="a?b=1&copy=2&amp;c" alt="R&D &lt;1"><script>a && b</script>')
    assert [b[2] for b in blocks] == ["ééé &copy &nosuch; …", None]
    assert blocks[1][3:5] == ("a?b=1&copy=2&c", ["R&D <1"])
