"""What a task of edge_values holds: one field's values of edges that no side of the join was sorted for."""

import re

from pyspark.sql import functions as F

from blockloom.operators import graph as G


def test_keywords_are_taken_apart_once_a_pair(spark):
    """1,000 chunks say the same of one pair: its three keywords are taken from one list, beside a description and 1,000 sources."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        chunks = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("chunk_id"))
        df = G.edge_values(G.belongs_to(chunks.withColumn("entity_name", F.lit("x")), chunks.withColumn("modal_entity_name", F.lit("y"))))
        got = {(r.field, r.n) for r in df.groupBy("field").agg(F.count("*").alias("n")).collect()}
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {("description", 1), ("source_id", 1000), ("keyword", 3)}
    text = plan.toString()
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" in text

    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    made = [n.metrics().apply("numOutputRows").value() for n in nodes(plan) if re.match("Generate explode", n.simpleString(100))]
    assert made == [3]
