"""The corpus pipeline: quality, toxicity, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. The classifiers are fitted on the labelled documents
among the stage's own input. Each stage begins with the executors' heaps shrunk to what is in use.

Defined results, for every stage but the last
- Columns beyond those of documents, whatever their names, pass through; nulls in any column
  are allowed, and an empty table gives an empty one.
- A null, empty or blank text is never rejected by a classifier and is no near copy; a null
  text is no exact copy either, while empty texts are exact copies of each other.
- Rows with a null doc_id stay, but as exact copies of a row with an id.
- Equal rows are judged alike by the classifiers; the exact stage keeps one of them, and the near
  stage keeps or drops them together.
- Without labels of both classes among its input a classifier's stage keeps everything.
- A very long text is judged whole. The last stage's cases are those of ``packing``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import exact_dedup, jaccard, packing, quality, toxicity
from spanloom.plans.session import give_back, materialize, scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    give_back(spark)
    return quality.filter_docs(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    give_back(spark)
    return toxicity.filter_docs(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the lowest doc_id stays.

    The documents arrive in two batches; the second is held against the index of the first.
    """
    give_back(spark)
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "pipeline-index"))
    first, *rest = (exact_dedup.dedup(batch, index=index) for batch in exact_dedup.arrivals(docs))
    return first.union(rest[0]) if rest else first


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    give_back(spark)
    return jaccard.dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in the training sequences."""
    give_back(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", near_stage),
    ("packing", packing_stage),
]

#: The trained classifiers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
