"""Sources: strings with stable numbers, and the segmentations that cover them whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.segmentation import Segmentation, no_annotations
from spanloom.plans.session import spread


def from_dataframe(df: DataFrame, id_col: str, text_col: str, annotations: Sequence[str] | dict[str, str] = (), label: str = "input_string") -> Segmentation:
    """One whole-string segment per row of any DataFrame (Parquet, JSON, CSV, text, JDBC...).

    id_col gives the string's number (an integer, unique); rows without a text are left out.
    annotations names columns to carry, or maps annotation keys to columns; null values are
    left out of the map.
    """
    named = annotations if isinstance(annotations, dict) else {c: c for c in annotations}
    if named:
        pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in named.items()))
        ann = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    else:
        ann = no_annotations()
    used = list(dict.fromkeys([id_col, text_col, *named.values()]))
    rows = spread(df.where(F.col(text_col).isNotNull()).select(*used)).select(
        F.col(id_col).cast("long").alias("str_index"),
        F.col(id_col).cast("long").alias("real_str_index"),
        F.lit(0).alias("start"),
        F.length(text_col).alias("end"),
        ann.alias("annotations"),
        F.col(text_col).alias("content"),
    )
    return Segmentation(rows, label, whole=True)


def from_texts(spark: SparkSession, texts: Sequence[str], label: str = "input_string", first_index: int = 0) -> Segmentation:
    """Literal strings, numbered from first_index."""
    df = spark.createDataFrame([(first_index + i, t) for i, t in enumerate(texts)], "id long, text string")
    return from_dataframe(df, "id", "text", label=label)


def from_text(spark: SparkSession, text: str | None, label: str = "input_string", index: int = 0) -> Segmentation:
    """One string as one segment; None gives an empty segmentation."""
    return from_texts(spark, [] if text is None else [text], label, index)


def from_spans(strings: Segmentation, spans: Sequence[tuple], label: str = "segmented_data") -> Segmentation:
    """Segments given as (str_index, start, end, annotations) over the strings of another segmentation.

    start None is 0 and end None is the string's end.
    """
    spark = strings.df.sparkSession
    rows = [(i, *(tuple(s) + (None,) * (4 - len(s)))) for i, s in enumerate(spans)]
    df = spark.createDataFrame(rows, "ord long, str_index long, start int, end int, ann map<string,string>")
    whole = strings.df.where("start = 0").select("str_index", "real_str_index", F.col("content").alias("text"))
    j = df.join(whole, "str_index").select(
        "ord", "str_index", "real_str_index", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.length("text")).alias("end"), F.coalesce("ann", no_annotations()).alias("annotations"), "text"
    )
    return Segmentation(j.withColumn("content", F.expr("substring(text, start + 1, `end` - start)")).drop("text"), label)


def with_pointers(strings: Segmentation, pointers: DataFrame) -> Segmentation:
    """Add strings that point to others: pointers has (str_index, target).

    A pointer to a pointer is followed to the string itself. Raises ValueError for a pointer
    to itself, to nowhere, or under a number that is taken.
    """
    p = pointers.select(F.col("str_index").cast("long").alias("p"), F.col("target").cast("long").alias("t"))
    s = strings.df.select("str_index", F.col("real_str_index").alias("real"), "end", "content", "annotations")
    bad = p.join(s.select("str_index"), p.t == F.col("str_index"), "left").where("p = t OR str_index IS NULL")
    taken = p.join(s.select("str_index"), p.p == F.col("str_index"))
    if not bad.isEmpty() or not taken.isEmpty():
        raise ValueError("a pointer refers to itself, to no string, or takes a string's number")
    new = p.join(s, p.t == F.col("str_index")).select(F.col("p").alias("str_index"), F.col("real").alias("real_str_index"), F.lit(0).alias("start"), "end", "annotations", "content")
    return Segmentation(strings.df.drop("ord").unionByName(new), strings.label, whole=True, pointers=True)


def update(strings: Segmentation, str_index: int, text: str | None, label: str | None = None) -> Segmentation:
    """A segmentation with one string's text replaced; None removes the string."""
    here = F.col("str_index") == str_index
    df = strings.df
    if text is None:
        return Segmentation(df.where(~here), label or strings.label, whole=strings.whole, pointers=strings.pointers)
    new = F.when(here, F.lit(text)).otherwise(F.col("content"))
    return Segmentation(df.withColumn("content", new).withColumn("end", F.when(here, F.lit(len(text))).otherwise(F.col("end"))), label or strings.label, whole=strings.whole, pointers=strings.pointers)
