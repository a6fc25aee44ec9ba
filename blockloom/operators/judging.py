"""Evaluation from end to end: questions, prompts for a judge, its scores, results in place of older ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models, repair
from ..functions.text import blank, strip
from . import evaluation as E

_RULES = {
    "accuracy": 'Judge whether the answer agrees with the expected one. Reply with JSON only: {"accuracy": 0 or 1, "reasoning": "why"}',
    "comprehensive": "Judge the answer against the expected one. Reply with JSON only: {"
    + ", ".join(['"accuracy": 0 or 1', *(f'"{d}": 0.0 to 1.0' for d in E.DIMENSIONS), '"reasoning": "why"'])
    + "}",
}


def prompt(question: Column, expected: Column, answer: Column, kind: str = "comprehensive") -> Column:
    """What a judge is asked: for accuracy alone or for all scores."""
    parts = [F.lit(_RULES[kind]), F.concat(F.lit("Question: "), question), F.concat(F.lit("Expected answer: "), F.coalesce(expected, F.lit(""))), F.concat(F.lit("Answer: "), F.coalesce(answer, F.lit("")))]
    return F.concat_ws("\n\n", *parts)


def questions(results: DataFrame) -> DataFrame:
    """doc_id, question, expected_answer, method, answer, error of results with a struct (success, result, error) for each mode; blank questions leave."""
    rows = F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"{m}_result").alias("r")) for m in E.MODES))
    out = results.where(~blank("question")).select("doc_id", strip("question").alias("question"), "expected_answer", F.inline(rows)).where("r is not null")
    return out.select("doc_id", "question", "expected_answer", "method", F.col("r.result").alias("answer"), F.when(~F.coalesce("r.success", F.lit(True)) | (F.coalesce("r.error", F.lit("")) != ""), F.coalesce("r.error", F.lit("failed"))).alias("error"))


def evaluate(asked: DataFrame, load: Callable, done: DataFrame | None = None, kind: str = "comprehensive", limit: int | None = None) -> DataFrame:
    """doc_id, question, method, accuracy, the further scores, reasoning, success, error of questions, judged by a model unless done has them.

    Rows with an error of their own aren't judged and fail. limit: questions at most."""
    todo = asked if done is None else E.pending(asked, done)
    todo = todo if limit is None else todo.limit(limit)
    ask = F.when(F.col("error").isNull(), prompt(F.col("question"), F.col("expected_answer"), F.col("answer"), kind))
    judged = todo.withColumn("_a", models.answers(ask, load)).withColumn("error", F.coalesce("error", "_a.error"))
    # a generator of one row keeps the Python function out of the expressions over its result
    judged = judged.withColumn("_s", F.explode(F.array(F.when(F.col("error").isNull(), repair.judged(F.col("_a.value"))))))
    return judged.select(*E.KEYS, *(F.col(f"_s.{k}").alias(k) for k in (*repair.SCORES, "reasoning")), F.col("error").isNull().alias("success"), "error")


def evaluate_files(spark: SparkSession, path: str, load: Callable, done: DataFrame | None = None, kind: str = "comprehensive") -> DataFrame:
    """evaluate() of all result files (JSON lists or lines) of a folder or pattern; doc_id is the file's stem where a row has none."""
    shape = "doc_id string, question string, expected_answer string, " + ", ".join(f"{m}_result struct<success:boolean,result:string,error:string>" for m in E.MODES)
    rows = spark.read.schema(shape).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return evaluate(questions(rows.withColumn("doc_id", F.coalesce("doc_id", stem))), load, done, kind)


def updated(done: DataFrame, new: DataFrame) -> DataFrame:
    """All results, new ones in place of older ones of their keys."""
    return E.replaced(done, new)
