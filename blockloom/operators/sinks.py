"""Sinks: caches of parsed files and answers, evaluation reports, question and answer files. Keyed tables: operators.tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shorten
from .tables import KeyedTable


def evaluation_report(results: DataFrame, folder: str) -> None:
    """All results as JSON and a summary with cut texts as CSV; the committer makes either whole or absent."""
    results.write.mode("overwrite").json(f"{folder}/results")
    cut = {"question": 100, "expected_answer": 100, "reasoning": 200}
    results.select(*(shorten(c, cut[c]).alias(c) if c in cut else F.col(c) for c in results.columns)).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")


def save_parsed(parsed: DataFrame, folder: str) -> int:
    """The parse cache: these files' rows (sources.files.dispatch) by cache_key; files that failed aren't kept. Returns the version."""
    return KeyedTable(parsed.sparkSession, folder, ["cache_key"]).upsert(parsed.where("error is null").select("cache_key", "path", "parser", "blocks").dropDuplicates(["cache_key"]))


def parsed_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    """What save_parsed() kept, none before the first time."""
    return KeyedTable(spark, folder, ["cache_key"]).read()


def save_answers(answered: DataFrame, folder: str) -> int:
    """The answer cache: the answers (pipeline.answered_with_items) that weren't taken from it and didn't fail, by cache_key. Returns the version."""
    new = answered.where("not cached and answer is not null").select("cache_key", "answer").dropDuplicates(["cache_key"])
    return KeyedTable(answered.sparkSession, folder, ["cache_key"]).upsert(new)


def answer_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    """What save_answers() kept, none before the first time."""
    return KeyedTable(spark, folder, ["cache_key"]).read()


def answer_files(answers: DataFrame, folder: str, began: float, ended: float) -> None:
    """Questions with their answers as JSON lines, and one row of figures as CSV: how many, how many failed, seconds in all and for each."""
    answers.write.mode("overwrite").json(f"{folder}/answers")
    done = answers.sparkSession.read.schema("query_id string, answer string, error string").json(f"{folder}/answers")
    n = done.agg(F.count("*").alias("n_questions"), F.count_if(F.col("error").isNotNull() | F.col("answer").isNull()).alias("n_failed"))
    n = n.withColumns({"seconds": F.lit(round(ended - began, 3)), "seconds_each": F.round(F.try_divide(F.lit(ended - began), F.col("n_questions")), 6)})
    n.write.mode("overwrite").option("header", True).csv(f"{folder}/timing")


def question_bank(spark: SparkSession, path: str, limit: int | None = None, column: str = "question") -> DataFrame:
    """question and answer of JSON lines, of files that each hold a JSON list, or of workbooks whose first sheet has a column of that name (any case); blank questions left out."""
    if path.lower().endswith(".xlsx"):
        df = workbook(spark, path)
        df = df.select(F.map_from_entries(F.transform(F.map_entries("row"), lambda e: F.struct(F.lower(F.trim(e["key"])), e["value"]))).alias("r"))
        df = df.select(F.col("r")[column.lower()].alias("question"), F.coalesce(F.col("r")["answer"], F.col("r")["correct_answer"]).alias("answer"))
    else:
        df = spark.read.schema("question string, answer string, correct_answer string").option("multiLine", path.endswith(".json")).json(path)
        df = df.select("question", F.coalesce("answer", "correct_answer").alias("answer"))
    df = df.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    return df if limit is None else df.limit(limit)


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """path, pos and row (a map from the first row's names to the cells' texts) of workbooks' first sheets."""

    @F.arrow_udf("array<map<string,string>>")
    def rows(contents: pa.Array) -> pa.Array:
        return pa.array([[list(r.items()) for r in sheet_rows(c)] for c in contents.to_pylist()], pa.list_(pa.map_(pa.string(), pa.string())))

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.posexplode(rows("content")).alias("pos", "row"))


def sheet_rows(raw: bytes) -> list[dict[str, str]]:
    """The rows of a workbook's first sheet below its row of names; empty cells and cells without a name are left out."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        texts = lambda node: "".join(t.text or "" for t in node.iter(f"{space}t"))
        shared = [texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{space}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        lines = []
        for row in ElementTree.fromstring(z.read(sheets[0])).iter(f"{space}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.findall(f"{space}c")):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else k
                value = c.find(f"{space}v")
                text = shared[int(value.text)] if c.get("t") == "s" and value is not None else texts(c) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                if text:
                    cells[at] = text
            lines.append(cells)
    names = lines[0] if lines else {}
    return [{names[k]: v for k, v in cells.items() if k in names} for cells in lines[1:]]
