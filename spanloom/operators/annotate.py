"""Annotation of contexts with the units they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.contain import contained, contained_sequences
from spanloom.operators.counting import GLOBAL, ngrams
from spanloom.operators.segmentation import Segmentation


def annotate_contexts(
    units: Segmentation, contexts: Segmentation | None = None, unit_key: str | None = None, context_key: str | None = None, merge_contexts: bool = False,
    seq_length: int = 1, delimiter: str = "#", sort_order: str = "Frequency", reverse: bool = True, keep_only_first: bool = True, value_delimiter: str = "|",
) -> DataFrame:
    """(context, annotation): each context type's unit types, by frequency or code points.

    The first one is kept, or all of them are joined. Types of equal frequency stand in the
    order in which they are first met. Contexts without units are left out.
    """
    if sort_order not in ("Frequency", "ASCII"):
        raise ValueError("sort_order must be Frequency or ASCII")
    if contexts is None:
        g = ngrams(units, seq_length, unit_key, delimiter)
        seen = g.select(F.lit(GLOBAL).alias("context"), F.col("gram").alias("unit"), F.struct(F.lit(0).cast("long").alias("c"), F.col("ord").alias("u")).alias("at"))
    else:
        ctx = F.lit(GLOBAL) if merge_contexts else contexts.item_or_none(context_key)
        if seq_length == 1:
            inside = contained(units, contexts, {"u_ord": F.col("ord"), "unit": units.item_or_none(unit_key)}, {"ctx_ord": F.col("ord"), "context": ctx})
        else:
            x = contained_sequences(units, contexts, seq_length, units.item_or_none(unit_key), {"context": ctx})
            inside = x.select("context", "ctx_ord", "u_ord", F.array_join("items", delimiter).alias("unit"))
        seen = inside.select("context", "unit", F.struct(F.col("ctx_ord").alias("c"), F.col("u_ord").alias("u")).alias("at"))
    types = seen.groupBy("context", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    if sort_order == "Frequency":
        key = F.struct((-F.col("n") if reverse else F.col("n")).alias("k"), "at", "unit")
        if keep_only_first:
            return types.groupBy("context").agg(F.min_by("unit", key).alias("annotation"))
        ranked = types.groupBy("context").agg(F.array_sort(F.collect_list(key)).alias("xs"))
        return ranked.select("context", F.array_join(F.transform("xs", lambda x: x["unit"]), value_delimiter).alias("annotation"))
    if keep_only_first:
        return types.groupBy("context").agg((F.max if reverse else F.min)("unit").alias("annotation"))
    ranked = types.groupBy("context").agg(F.sort_array(F.collect_list("unit"), asc=not reverse).alias("xs"))
    return ranked.select("context", F.array_join("xs", value_delimiter).alias("annotation"))
