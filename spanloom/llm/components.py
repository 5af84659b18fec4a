"""Connected components of an edge table by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b); root is the component's least vertex.

    A round takes two joins and two aggregations over (vertex, label) rows only, and its
    result is written to shared storage; rounds grow with the logarithm of a component's
    diameter. It ends when a round changes no label.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).where("u <> v").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("root").alias("r")), "u").groupBy("v").agg(F.min("r").alias("r"))
        hooked = labels.join(near, "v").select("v", "root", F.least("root", "r").alias("low"))
        # tell the old root of the lower label as well, then jump
        told = hooked.groupBy(F.col("root").alias("v")).agg(F.min("low").alias("t"))
        low = hooked.join(told, "v", "left").select("v", "root", F.least("low", F.coalesce("t", "low")).alias("low"))
        low = materialize(low, "hooked")
        jump = low.select(F.col("v").alias("low"), F.col("low").alias("far"))
        new = low.join(jump, "low", "left").select("v", "root", F.least(F.col("low"), F.coalesce("far", "low")).alias("new"))
        new = materialize(new, "jumped")
        changed = not new.where("root <> new").isEmpty()
        labels = new.select("v", F.col("new").alias("root"))
        if not changed:
            return labels
