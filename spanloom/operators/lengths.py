"""Lengths: how many units contexts, or the averaging units inside them, hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.patterns import portable
from spanloom.operators.contain import contained
from spanloom.operators.counting import GLOBAL
from spanloom.operators.segmentation import Segmentation

#: Ordinals per block of a sliding frame; a block is one partition of the window.
FRAME = 65_536


def lengths_of(holders: Segmentation, units: Segmentation) -> DataFrame:
    """(h_ord, length): how many units lie in each holder, 0 where there are none.

    Plain tokens of disjoint holders are counted in the holders' own text, without a join.
    """
    h = holders.ordered
    if units.recipe and units.recipe[0] is holders and holders.disjoint and portable(units.recipe[1]):
        return h.select(F.col("ord").alias("h_ord"), F.regexp_count("content", F.lit(units.recipe[1])).cast("long").alias("length"))
    inside = contained(units, holders, {}, {"in_ord": F.col("ord")}).groupBy("in_ord").agg(F.count(F.lit(1)).alias("n"))
    return h.select(F.col("ord").alias("h_ord")).join(inside, F.col("h_ord") == F.col("in_ord"), "left").select("h_ord", F.coalesce("n", F.lit(0)).cast("long").alias("length"))


def _moments(lengths: DataFrame, std_deviation: bool, by: list[str]) -> DataFrame:
    aggs = [F.avg("length").alias("length_average"), F.count("length").alias("length_count")]
    if std_deviation:
        aggs.append(F.stddev_pop("length").alias("length_std_deviation"))
    return lengths.groupBy(*by).agg(*aggs)


def length_in_context(
    units: Segmentation, averaging: Segmentation | None = None, contexts: Segmentation | None = None, context_key: str | None = None,
    merge_contexts: bool = False, std_deviation: bool = False,
) -> DataFrame:
    """Lengths by context type, in units.

    Without averaging units (context, length); with them (context, length_average,
    length_count[, length_std_deviation]) over the averaging units inside the contexts, those
    without units counting 0. Contexts whose length or average is 0, or that hold no averaging
    unit, are left out. The deviation is that of a population.
    """
    if contexts is None:
        if averaging is None:
            return units.df.agg(F.count(F.lit(1)).alias("length")).where("length > 0").select(F.lit(GLOBAL).alias("context"), "length")
        per = lengths_of(averaging, units).withColumn("context", F.lit(GLOBAL))
        return _moments(per, std_deviation, ["context"]).where("length_average > 0")
    ctx = F.lit(GLOBAL) if merge_contexts else contexts.item_or_none(context_key)
    if averaging is None:
        if units.recipe and units.recipe[0] is contexts and contexts.disjoint and portable(units.recipe[1]):
            per = contexts.df.select(ctx.alias("context"), F.regexp_count("content", F.lit(units.recipe[1])).cast("long").alias("n"))
            return per.groupBy("context").agg(F.sum("n").alias("length")).where("length > 0")
        return contained(units, contexts, {}, {"context": ctx}).groupBy("context").agg(F.count(F.lit(1)).alias("length"))
    per = lengths_of(averaging, units)
    inside = contained(averaging, contexts, {"a_ord": F.col("ord")}, {"context": ctx})
    return _moments(inside.join(per, F.col("a_ord") == F.col("h_ord")), std_deviation, ["context"]).where("length_average > 0")


def sliding(df: DataFrame, size: int, frame: int = FRAME) -> DataFrame:
    """Add block to rows (ord, ...): frames of size rows that begin in a block find all their rows there.

    Rows near a block's beginning are copied to the block before, so a frame over
    ``partitionBy(block)`` is distributed; frames are whole where their block is theirs.
    """
    b = max(frame, 4 * size)
    own, before = F.floor(F.col("ord") / b), F.floor((F.col("ord") - size + 1) / b)
    blocks = F.filter(F.array_distinct(F.array(own, before)), lambda x: x >= 0)
    return df.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.floor(F.col("ord") / b))


def length_in_window(units: Segmentation, averaging: Segmentation, window_size: int = 1, std_deviation: bool = False) -> DataFrame:
    """(context, length_average, length_count[, length_std_deviation]) of each window of consecutive averaging units.

    Windows are numbered from 1; without enough averaging units there are none.
    """
    if window_size < 1:
        raise ValueError("a window must hold a unit")
    per = lengths_of(averaging, units).withColumnRenamed("h_ord", "ord")
    w = W.partitionBy("block").orderBy("ord").rowsBetween(0, window_size - 1)
    x = sliding(per, window_size).select(
        "ord", "own", F.count(F.lit(1)).over(w).alias("k"), F.sum("length").over(w).alias("s"), F.sum(F.col("length") * F.col("length")).over(w).alias("q")
    ).where((F.col("k") == window_size) & F.col("own"))
    mean = F.col("s") / window_size
    cols = [(F.col("ord") + 1).cast("long").alias("context"), mean.alias("length_average"), F.col("k").alias("length_count")]
    if std_deviation:
        cols.append(F.sqrt(F.greatest(F.col("q") / window_size - mean * mean, F.lit(0.0))).alias("length_std_deviation"))
    return x.select(*cols)
