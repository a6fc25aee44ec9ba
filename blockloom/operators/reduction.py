"""Many descriptions of one name become one, in rounds; nothing is cut.

What fits a budget of tokens together is joined as it is. Of other names the descriptions are packed in order, a pack
holding those that start within its budget (two at least, whatever their size), and the model sums up each pack of more
than one; the sums are packed again until a name has one. A name's descriptions are dealt by hash to buckets of SPAN packs,
so that no task sorts all of a name's; packs are numbered by a running sum, and only a pack is ever one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import models
from ..functions.text import tokens
from ..joins import spread_join
from ..shared import durable

BUDGET, SPAN, FEWEST = 1200, 64, 128  # tokens of a pack, packs of a bucket, a bucket's values on average
ASK = "Merge these descriptions of {} into one that keeps all they say:\n"


def bucket_of(value: Column, buckets: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long") % buckets


def reduced(values: DataFrame, keys: list[str], load: Callable, budget: int = BUDGET, value: str = "description", size: Callable[[Column], Column] = tokens, name: Column | None = None, span: int = SPAN) -> DataFrame:
    """keys, value, n_values, n_calls, n_failed: one row for each key that has a value that isn't null or empty; each value counts once.

    load: the model; name: what its question calls the key, by default its first column. A pack whose call fails is joined as it is."""
    name = F.col(keys[0]).cast("string") if name is None else name
    given = values.select(*keys, F.col(value).alias("value")).where("value is not null and value <> ''").distinct()
    rows = given.withColumns({"b": F.lit(0).cast("long"), "p": F.lit(0).cast("long"), "calls": F.lit(0).cast("long"), "failed": F.lit(0).cast("long"), "values": F.lit(1).cast("long")})
    rows, out, first = durable(rows.withColumn("size", F.greatest(F.lit(1), size(F.col("value"))).cast("long"))), None, True
    while True:
        sums = durable(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("total")))
        whole = (F.col("n") == 1) | (F.col("total") <= budget) if first else F.col("n") == 1
        n = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
        # a row here is a name whose values fit a budget together, so its list is bounded
        met = spread_join(rows, sums.select(*keys, "n", whole.alias("whole"), F.greatest(F.lit(1), F.least(F.ceil(F.col("total") / (budget * span)), F.floor(F.col("n") / FEWEST))).cast("long").alias("buckets")), keys, n)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "p", "value"))), lambda x: x["value"]), "\n")
        done = met.where("whole").groupBy(*keys).agg(joined.alias(value), F.sum("values").alias("n_values"), F.sum("calls").alias("n_calls"), F.sum("failed").alias("n_failed"))
        out = done if out is None else out.unionByName(done)
        if sums.where(~whole).isEmpty():
            return out
        dealt = met.where("not whole").drop("whole").withColumn("bucket", bucket_of(F.col("value"), F.col("buckets")))
        order = W.partitionBy(*keys, "bucket").orderBy("b", "p", "value")
        before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        pack = F.least(F.floor(before / budget), F.floor((F.row_number().over(order) - 1) / 2)).cast("long")
        packs = dealt.withColumn("pack", pack).groupBy(*keys, "bucket", "pack")
        packs = packs.agg(F.count("*").alias("n"), joined.alias("value"), F.sum("calls").alias("calls"), F.sum("failed").alias("failed"), F.sum("values").alias("values"))
        asked = F.when(F.col("n") > 1, F.concat(F.format_string(ASK.replace("{}", "%s"), name), F.col("value")))
        told = packs.withColumn("answer", models.answers(asked, load))
        more, bad = (F.col("n") > 1).cast("long"), F.col("answer.error").isNotNull().cast("long")
        rows = told.select(*keys, F.coalesce("answer.value", "value").alias("value"), F.col("bucket").alias("b"), F.col("pack").alias("p"), (F.col("calls") + more).alias("calls"), (F.col("failed") + bad).alias("failed"), "values")
        rows, first = durable(rows.withColumn("size", F.greatest(F.lit(1), size(F.col("value"))).cast("long"))), False
