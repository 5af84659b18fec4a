"""Streaming counts: the tokenizer and unit counts over an unbounded table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_tokens(docs: DataFrame, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (unit, *keep) per match of a Java pattern; stateless, for streams and tables alike."""
    return docs.select(*keep, F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))).alias("unit"))


def stream_counts(docs: DataFrame, pattern: str, text_col: str = "text", context_col: str | None = None, time_col: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Running counts of (context, unit), in event-time windows with a watermark if time_col is given.

    Without a time column the state grows with the number of types; with one, windows are
    dropped from it once the watermark has passed.
    """
    if time_col:
        docs = docs.withWatermark(time_col, late)
    keep = tuple(c for c in (context_col, time_col) if c)
    by = [F.col(context_col).cast("string").alias("context")] if context_col else [F.lit("__global__").alias("context")]
    if time_col:
        by.append(F.window(time_col, window).alias("window"))
    return stream_tokens(docs, pattern, text_col, keep).groupBy(*by, "unit").agg(F.count(F.lit(1)).alias("value"))
