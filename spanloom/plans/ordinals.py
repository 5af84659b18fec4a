"""Global ranks, ordinals and prefix sums without a global sort in one task.

Rows are partitioned by ranges of their order, which are as even as a sample of it can make
them, whatever the values; written; and numbered inside their partition. Only a row per
partition meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.plans.session import materialize


def blocked(df: DataFrame, *order: str | Column) -> DataFrame:
    """df, written, with part: rows of a lower part come first in that order."""
    return materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def _bases(placed: DataFrame, total: Column) -> DataFrame:
    """(part, base): the totals of the parts before; one row per partition."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    per = placed.groupBy("part").agg(total.alias("total"))
    return F.broadcast(per.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))


def ranks(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """df with name = 0, 1, 2, ... in that order, which should have no ties."""
    placed = blocked(df, *order)
    at = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return placed.join(_bases(placed, F.count(F.lit(1))), "part").withColumn(name, (F.col("base") + at).cast("long")).drop("part", "base")


def prefix_sums(df: DataFrame, key: str, n: str = "n", name: str = "offset") -> DataFrame:
    """(key, n, name): the sum of n over the rows with lower keys; keys are unique."""
    placed = blocked(df.select(key, n), key)
    inside = W.partitionBy("part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return placed.join(_bases(placed, F.sum(n)), "part").select(key, n, (F.col("base") + F.coalesce(F.sum(n).over(inside), F.lit(0))).cast("long").alias(name))


def with_ordinals(df: DataFrame, *order: str | Column, key: str = "str_index", name: str = "ord") -> DataFrame:
    """df with name = 0, 1, 2, ... by (key, *order).

    One shuffle by key serves both the ranks within a string and the join with the
    offsets; the offsets themselves come from one aggregated row per string.
    """
    df = df.drop(name)
    offsets = prefix_sums(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key).select(key, "offset")
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.join(offsets, key).withColumn(name, (F.col("offset") + F.col("_rank") - 1).cast("long")).drop("_rank", "offset")
