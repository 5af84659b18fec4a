"""Packing: Harmonic packing of documents into training sequences.

A sequence holds ``capacity`` units: words of a text, or the elements of an array such as the
token ids of ``bpe.encode``. A document longer than that gives whole sequences of its own and a
remainder. A piece of n units is in class k = floor(capacity / n): k such pieces always fit, and
each bin of class k takes exactly k pieces (the last bin of a class may hold fewer). Nothing but
a piece's class and its place among the pieces of that class decides its bin, so classes and
shards fill their bins independently on any worker. A bin's pieces are then put together into
the sequence, with their boundaries: no more than ``capacity`` units, however many documents.

Documents are spread over shards of about ``shard_docs`` documents by a hash of doc_id, so that
no class of any corpus is one task's work; at most one bin per class and shard stays open. A
piece is shuffled once, with its text.

Defined results
- Words are runs of characters other than space, tab, newline and carriage return; in a sequence
  one space stands between words, and SEPARATOR between pieces. Arrays are joined as they are.
- A null, empty or blank text, and a null or empty array, have no units and give no row. A null
  in an array is a unit like any other.
- A null doc_id is packed in shard 0, after the others. Equal rows are packed each.
- Ties don't occur: pieces are ordered by (doc_id, piece, units); equal pieces are alike.
- An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.common import quoted

CAPACITY = 2048
SHARD_DOCS = 100_000
#: What stands between two pieces of a sequence of words.
SEPARATOR = "\n\n"
_WORD = "[^ \\n\\t\\r]+"


def _placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with bin_class, bin_no and slot."""
    pieces = pieces.withColumn("bin_class", F.expr(f"{capacity} div n_units"))
    at = F.row_number().over(W.partitionBy("shard", "bin_class").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "units")).cast("long") - 1
    return pieces.withColumn("at", at).withColumns({"bin_no": F.expr("at div bin_class"), "slot": F.expr("at % bin_class")}).drop("at")


def _pieces(docs: DataFrame, id_col: str, units: Column, capacity: int, shard_docs: int) -> DataFrame:
    """(doc_id, shard, piece, n_units, units): each document's units cut at every capacity-th one."""
    if capacity < 1 or shard_docs < 1:
        raise ValueError("capacity and shard_docs must be positive")
    shards = max(1, -(-docs.count() // shard_docs))
    doc_id = quoted(id_col).cast("long")
    shard = F.coalesce(F.pmod(F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(shards)), F.lit(0)).cast("long")
    d = docs.select(doc_id.alias("doc_id"), shard.alias("shard"), units.alias("all")).where(F.size("all") > 0)
    cuts = F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(capacity)), lambda i: F.slice("all", i, capacity))
    each = d.select("doc_id", "shard", F.posexplode(cuts).alias("piece", "units"))
    return each.select("doc_id", "shard", F.col("piece").cast("long").alias("piece"), F.size("units").cast("long").alias("n_units"), "units")


def _sequences(placed: DataFrame, *more: Column) -> DataFrame:
    """One row per bin: its pieces in order of their slots; a bin is never more than capacity units."""
    bins = placed.groupBy("shard", "bin_class", "bin_no").agg(F.array_sort(F.collect_list(F.struct("slot", "doc_id", "piece", "n_units", "units"))).alias("ps"))
    return bins.select(
        "shard", "bin_class", "bin_no", F.col("ps.doc_id").alias("doc_ids"), F.col("ps.piece").alias("pieces"), F.col("ps.n_units").alias("lengths"),
        F.aggregate("ps", F.lit(0).cast("long"), lambda n, p: n + p["n_units"]).alias("n_units"), *more,
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per sequence of words: (shard, bin_class, bin_no, doc_ids, pieces, lengths, n_units, text).

    doc_ids, pieces and lengths have an element for each piece of the text, in order: the
    document, which of its pieces it is, and its words.
    """
    words = F.regexp_extract_all(quoted(text_col), F.lit(_WORD), F.lit(0))
    cut = _pieces(docs, id_col, words, capacity, shard_docs).withColumn("units", F.array_join("units", " "))
    return _sequences(_placed(cut, capacity), F.array_join(F.col("ps.units"), SEPARATOR).alias("text"))


def pack_arrays(rows: DataFrame, units_col: str, id_col: str = "doc_id", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per sequence of array elements, as ``pack``, with units in place of text: token ids, for one."""
    cut = _pieces(rows, id_col, quoted(units_col), capacity, shard_docs)
    return _sequences(_placed(cut, capacity), F.flatten(F.col("ps.units")).alias("units"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences, with the lists of their pieces as text."""
    lists = ("doc_ids", "pieces", "lengths")
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",", "null") for c in lists})


SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(text, '[^ \\n\\t\\r]+') AS ws FROM {{docs}}
), s AS (SELECT greatest(1, CAST(ceil(count(*) / {SHARD_DOCS}.0) AS BIGINT)) AS shards FROM {{docs}}
), p AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % shards AS shard, piece, ws[piece * {CAPACITY} + 1:(piece + 1) * {CAPACITY}] AS ws
  FROM (SELECT doc_id, ws, unnest(range(0, (len(ws) + {CAPACITY} - 1) // {CAPACITY})) AS piece FROM d WHERE len(ws) > 0), s
), c AS (
  SELECT doc_id, shard, piece, len(ws) AS n_units, array_to_string(ws, ' ') AS units, {CAPACITY} // len(ws) AS bin_class FROM p
), r AS (
  SELECT *, row_number() OVER (PARTITION BY shard, bin_class ORDER BY doc_id, piece, units) - 1 AS place FROM c
)
SELECT shard, bin_class, place // bin_class AS bin_no, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY place) AS doc_ids, string_agg(CAST(piece AS VARCHAR), ',' ORDER BY place) AS pieces, string_agg(CAST(n_units AS VARCHAR), ',' ORDER BY place) AS lengths,
  CAST(sum(n_units) AS BIGINT) AS n_units, string_agg(units, chr(10) || chr(10) ORDER BY place) AS text
FROM r GROUP BY 1, 2, 3
"""
