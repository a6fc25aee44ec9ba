"""Token counts: whole texts are encoded in Arrow batches and only the lengths come back.

A long text is cut where no token can cross: before a space that follows another character, when no entry of the
vocabulary holds the space mark anywhere but at its start (checked when the model is loaded). The model prefixes each
piece it is given with that mark, which stands for the space dropped at the cut. Pieces are then encoded in groups of
about GROUP_BYTES, so a batch of long texts costs no more memory than one of short ones.

Nulls and empty texts have no bytes and no tokens; every input row gives one row; an empty table gives none. A text
without spaces is encoded in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, session_of, table

MODEL = "piece_bpe_32k.model"
OVER, PIECE_CHARS, GROUP_BYTES = 4096, 16_384, 1 << 19
MARK = "▁"
_loaded: dict = {}


def load(path: str | None):
    """The model and whether texts may be cut at spaces; once for each worker."""
    if path not in _loaded:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        lead = re.compile(f"{MARK}*[^{MARK}]*")
        cut = all(lead.fullmatch(model.id_to_piece(i)) for i in range(model.get_piece_size()))
        probe = "a b  c"  # the prefix must stand for the space at a cut, and runs of spaces must be kept
        cut = cut and model.encode(probe) == model.encode("a") + model.encode("b") + model.encode(" c")
        _loaded[path] = model, cut
    return _loaded[path]


def cuts(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text in pieces of about size characters; the space at a cut is dropped."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and text[at - 1] in (" ", MARK):
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 == len(text):
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


def lengths(texts: list[str], path: str | None = None) -> list[int]:
    model, cut = load(path)
    out, owners, group, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, ids in zip(owners, model.encode(group, num_threads=1), strict=True):
            out[i] += len(ids)
        owners.clear()
        group.clear()

    for i, text in enumerate(texts):
        for piece in cuts(text) if cut else [text]:
            owners.append(i)
            group.append(piece)
            held += len(piece.encode())
            if held >= GROUP_BYTES:
                flush()
                held = 0
    flush()
    return out


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str | None = None, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    session_of(docs)
    slim = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column("text")
            n = lengths(texts.to_pylist(), model_path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > over for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
