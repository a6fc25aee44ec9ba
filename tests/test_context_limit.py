"""Texts that end just at the limit of a block's context."""

import pytest

from blockloom.config import Config
from blockloom.operators import context as O

BLOCKS = "array<struct<pos:int,type:string,page_idx:int,text:string,text_level:int,img_path:string,captions:array<string>,table_body:string,text_format:string>>"


@pytest.mark.parametrize("first", range(17, 23))
def test_text_behind_the_limit_is_seen(spark, first):
    """Texts of first characters and of one, beside a limit of 20: the second is cut off, with dots, once the first has 19."""
    row = lambda pos, kind, text: (pos, kind, 0, text, 0, None, None, None, None)
    df = spark.createDataFrame([(1, [row(0, "text", "a" * first), row(1, "text", "b"), row(2, "equation", "x")])], f"doc_id long, blocks {BLOCKS}")
    config = Config(max_context_tokens=20)
    whole = "a" * first + "\nb"
    # the line end stands at more than 80 % of the limit, so the cut goes before it
    want = whole if len(whole) <= 20 else "a" * first if first < 20 else "a" * 20 + "..."
    got = O.page_context(df.selectExpr("doc_id", "inline(blocks)"), config).first()["context"]
    assert got == want == O.document_context(df, config).first()["context"]
