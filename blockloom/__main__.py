"""python -m blockloom NAME SF_DIR OUT: runs a registered query and writes its rows as Parquet. Without arguments: the names.

python -m blockloom parse FOLDER OUT: reads a folder's files to blocks (OUT/files as Parquet; failed ones have their error).
python -m blockloom list FOLDER OUT: which files there are and which parser each would go to, nothing read.
python -m blockloom questions BANK OUT: the questions of a bank (JSON lines, a JSON list or a workbook) as JSON lines.
python -m blockloom ingest FOLDER OUT MODEL: a folder from end to end; each relation as Parquet below OUT, what was parsed in OUT/files.
python -m blockloom answer BANK OUT MODEL CHUNKS VECTORS DIM: a bank's questions by the chunks of an ingest (its OUT/chunks), found by VECTORS, a model of DIM components.
python -m blockloom evaluate RESULTS OUT MODEL: answers judged by a model: OUT/results as JSON, OUT/summary as CSV.

MODEL is module:function of a function that loads a model (functions.models)."""

from __future__ import annotations

import dataclasses
import importlib
import sys
import time


def _model(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(args: list[str]) -> int:
    from .catalog import QUERIES

    if not args:
        print("\n".join(sorted(QUERIES)))
        return 0
    name = args[0]
    needed = {"parse": 3, "list": 3, "questions": 3, "ingest": 4, "answer": 7, "evaluate": 4, **dict.fromkeys(QUERIES, 3)}
    if len(args) != needed.get(name):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from pyspark.sql import functions as F

    from .config import Config
    from .functions import models
    from .operators import extraction, judging, pipeline, retrieval, sinks
    from .sources import files

    spark = SparkSession.builder.appName(f"blockloom {name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    exts = files.extensions()
    if name == "parse":
        files.dispatch(files.scan_folder(spark, args[1], exts), files.Registry(files.builtin_parsers())).write.parquet(f"{args[2]}/files")
    elif name == "list":
        files.listing(spark, args[1], exts).withColumn("parser", files.route("path")).write.json(args[2])
    elif name == "questions":
        sinks.question_bank(spark, args[1]).write.json(args[2])
    elif name == "ingest":
        load = _model(args[3])
        parsed, out = pipeline.ingest_folder(spark, args[1], files.Registry(files.builtin_parsers()), load, extraction.extractor(load), summarise=load)
        parsed.write.parquet(f"{args[2]}/files")
        for relation in dataclasses.fields(out):
            getattr(out, relation.name).write.parquet(f"{args[2]}/{relation.name}")
    elif name == "answer":
        began, vectors, dim = time.time(), _model(args[5]), int(args[6])
        chunks = spark.read.parquet(args[4]).select("chunk_id", "content").dropDuplicates(["chunk_id"])
        asked = sinks.question_bank(spark, args[1]).select(F.md5("question").alias("query_id"), "question").dropDuplicates(["query_id"])
        of = lambda df, i, text: df.select(F.col(i).alias("vec_id"), models.embeddings(F.col(text), vectors, dim).alias("embedding"))
        hits = retrieval.top_k(of(asked, "query_id", "question"), of(chunks, "chunk_id", "content"), Config().top_k, self_match=True)
        found = retrieval.ranked(retrieval.naive(hits), Config().top_k)
        sinks.answer_files(pipeline.answered(asked, found, chunks, _model(args[3])), args[2], began, time.time())
    elif name == "evaluate":
        sinks.evaluation_report(judging.evaluate_files(spark, args[1], _model(args[3])), args[2])
    else:
        QUERIES[name](spark, args[1]).write.parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
