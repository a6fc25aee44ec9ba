import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import tokens

MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))


def want(text):
    return len(MODEL.encode(text or ""))


def test_whole_texts(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["the", "Ünïcode", "a" * 40, "<s>", "▁", "x\ny", "", "  ", "日本語", "🙂"]) for _ in range(30_000))
    texts = [None, "", " ", "a ", " a", "a  b", "▁", "a ▁ b", "<s></s><unk>", "\t\n", long, long + " ", "y" * 60_000, " " * 40_000, ("word " * 9000)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "a b", "x"), (0, None, "x")], "doc_id long, text string, n_bytes string")
    got = tokens.count_tokens(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), want(t), want(t) > 4096)
    assert tokens.count_tokens(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab ▁\n\tÉ.<s>")), max_size=60), st.integers(1, 12))
def test_cuts_never_change_a_count(text, size):
    pieces = list(tokens.cuts(text, size))
    assert sum(want(p) for p in pieces) == want(text)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.count_tokens(docs).collect():
        assert r.n_tokens == want(texts[r.doc_id])


def test_model_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert tokens.count_tokens(df, model_path=public_tokenizers.path(tokens.MODEL)).first().n_tokens == want("a b c")
    with pytest.raises(Exception):
        tokens.count_tokens(df, model_path="/nowhere.model").collect()
