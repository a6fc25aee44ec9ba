"""From documents to training shards: reject, deduplicate, decontaminate, mix, shard.

Null texts are empty texts: the classifier scores them like any other, equal ones are one group, they hold no item, and they mix and
shard by their empty text. Null ids are ids of their own: rows with null ids train nothing, come after other ids when a group's row
is chosen, and rows that agree in id and text count once in a group. A null source is a source. Of an empty table nothing is left, and every stage gives
its columns; without labels, or with one label only, all rows score that label's share, so all stay or all go; without items nothing
is contaminated. Further columns, whatever their names, stay with their rows, except that the last stage's five replace columns of their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import decontamination, mixing, quality, sharding, simhash
from blockloom.llm.common import col, table
from blockloom.shared import shared_folder

#: Near-duplicates are of five-word shingles: within 3 of 64 bits, or sharing 0.8 of them.
SHINGLE_WORDS = 5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts to be good; it learns from labelled rows of docs that aren't held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select(*map(col, docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return simhash.deduplicate(docs, words=SHINGLE_WORDS)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whether verbatim or edited."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated to their sources' target rates, in a global pseudo-random order."""
    return mixing.mix(docs).select(*map(col, docs.columns))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shards."""
    return sharding.shard(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_test_items),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SimHash, alignment and a trained classifier have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read by the next; they are deleted when that has written its own."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
