"""Interval containment: which units lie inside which contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.operators.segmentation import Segmentation

#: Characters per bin of the join; a context meets only units that begin in its bins.
BIN = 512


def contained(units: Segmentation, contexts: Segmentation, unit_cols: dict[str, Column], ctx_cols: dict[str, Column], bin_size: int = BIN) -> DataFrame:
    """One row per (context, unit inside it), with the columns asked for of either.

    unit_cols and ctx_cols map output names to expressions over the segments' columns.
    Whole-string contexts join on the string alone. Others are exploded into the bins they
    span, so a long document is cut by place and its pairs don't multiply. A unit is inside
    if its string is the context's and its start and end don't lie outside.
    """
    u = units.ordered if _uses_ord(unit_cols) else units.df
    c = contexts.ordered if _uses_ord(ctx_cols) else contexts.df
    u = u.select(F.col("str_index").alias("u_str"), F.col("start").alias("u_start"), F.col("end").alias("u_end"), *(e.alias(n) for n, e in unit_cols.items()))
    c = c.select(F.col("str_index").alias("c_str"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), *(e.alias(n) for n, e in ctx_cols.items()))
    inside = (F.col("u_start") >= F.col("c_start")) & (F.col("u_end") <= F.col("c_end"))
    if contexts.whole:
        j = u.join(c, (F.col("u_str") == F.col("c_str")) & inside)
    else:
        c = c.withColumn("c_bin", F.explode(F.sequence(F.expr(f"c_start div {bin_size}"), F.expr(f"c_end div {bin_size}"))))
        u = u.withColumn("u_bin", F.expr(f"u_start div {bin_size}"))
        j = u.join(c, (F.col("u_str") == F.col("c_str")) & (F.col("u_bin") == F.col("c_bin")) & inside)
    return j.select(*unit_cols, *ctx_cols)


def contains(outer: str = "", inner: str = "i_") -> Column:
    """Whether one segment holds another: the same string, and no end outside. The arguments prefix the address columns."""
    o, i = ({c: F.col(f"{p}{c}") for c in ("str_index", "start", "end")} for p in (outer, inner))
    return (o["str_index"] == i["str_index"]) & (o["start"] <= i["start"]) & (i["end"] <= o["end"])


def contained_sequences(units: Segmentation, contexts: Segmentation, n: int, item: Column, ctx_cols: dict[str, Column]) -> DataFrame:
    """(ctx_ord, u_ord, items, ..): the n units of consecutive ordinals from each unit on that lie inside a context."""
    rows = contained(units, contexts, {"u_ord": F.col("ord"), "item": item}, {"ctx_ord": F.col("ord"), **ctx_cols})
    w = W.partitionBy("ctx_ord").orderBy("u_ord")
    items = F.array(F.col("item"), *(F.lead("item", k).over(w) for k in range(1, n)))
    last = F.lead("u_ord", n - 1).over(w) if n > 1 else F.col("u_ord")
    rows = rows.select("ctx_ord", "u_ord", items.alias("items"), *ctx_cols, (last - F.col("u_ord")).alias("gap"))
    return rows.where(F.col("gap") == n - 1).drop("gap")


def _uses_ord(cols: dict[str, Column]) -> bool:
    return any("ord" in str(e) for e in cols.values())
