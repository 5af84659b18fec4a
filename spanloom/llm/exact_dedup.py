"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

The index is a bucketed table of (digest, doc_id) in a caller-named folder, sorted by
digest inside each bucket. A new batch is deduplicated in itself, then against the index
by a sort-merge anti-join on digest, and the digests that are new are appended. The number of
buckets is stored beside the data, as reading with another one would miss digests.

Defined results
- Two texts are copies when their bytes are equal; the digest is SHA-256 of the UTF-8 text.
- Of the copies in a batch the one with the lowest doc_id stays (a null doc_id ranks last);
  rows that agree in doc_id and text count as one and a single one of them stays.
- A null text is never a copy; such rows all stay and don't enter the index.
- The empty text is a text like any other. An empty batch gives an empty result.
- An index is always read under the number of buckets it was made with, whatever the session's
  settings; asking for another number raises ValueError.
- Other columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, named_apart, quoted, ship
from spanloom.plans.session import materialize, scratch_path, small_or_plain


def digest(text) -> F.Column:
    """SHA-256 of the text as 32 bytes; null for null."""
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """The digests seen so far: an external table CLUSTERED BY (digest) SORTED BY (digest).

    The folder outlives the session. It holds ``_layout``, with the number of buckets and the
    version of the data, and that version's folder. A join on digest reads the table bucket by
    bucket without an exchange, so however large the index is, only the new batch's digests are
    shuffled. The number of buckets is fixed when the index is made; by default it is the
    session's number of shuffle partitions then, so that a bucket is as much as one task should
    join. Each append adds a file to each bucket; ``compact`` writes one sorted file per bucket
    again, as a new version that takes the old one's place once it is whole.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        layout = self._layout()
        if layout is None:
            if buckets is not None and buckets < 1:
                raise ValueError("buckets must be positive")
            layout = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "version": 0}
            self._store(layout)
        elif buckets is not None and buckets != layout["buckets"]:
            raise ValueError(f"the index has {layout['buckets']} buckets, not {buckets}")
        self.buckets = layout["buckets"]
        self._register(layout["version"])

    def _fs(self, *parts: str):
        """(file system, path) of a place in the index's folder."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _layout(self) -> dict | None:
        # a writer that broke off between deleting and renaming leaves the new file alone
        fs, p = next(((fs, p) for fs, p in (self._fs("_layout"), self._fs("_layout.new")) if fs.exists(p)), (None, None))
        if fs is None:
            return None
        stream = fs.open(p)
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _store(self, layout: dict) -> None:
        fs, new = self._fs("_layout.new")
        out = fs.create(new, True)
        out.writeUTF(json.dumps(layout))
        out.close()
        _, p = self._fs("_layout")
        fs.delete(p, False)
        fs.rename(new, p)

    def _register(self, version: int) -> None:
        """Name the version's folder in the session's catalogue, under the layout it was written with."""
        self.version = version
        self.name = "digest_index_" + hashlib.md5(f"{self.path} {version}".encode()).hexdigest()[:16]
        where = f"{self.path}/v{version}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, doc_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{where}'"
        )

    def read(self) -> DataFrame:
        """(digest, doc_id), digests unique."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, mode: str, name: str, **options: str) -> None:
        # by the bucket's number: of a bucketed table, a repartition by digest itself would be left out
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        rows = rows.select("digest", "doc_id").repartition(self.buckets, bucket)
        rows.write.format("parquet").mode(mode).options(**options).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def append(self, new: DataFrame) -> None:
        """Add (digest, doc_id) rows: one file per bucket, sorted by digest."""
        self._write(new, "append", self.name)

    def compact(self) -> None:
        """One sorted file per bucket again; a failure leaves the old version in place."""
        old, version = self.name, self.version + 1
        fs, p = self._fs(f"v{version}")
        fs.delete(p, True)  # what a broken compaction left
        self._write(self.read(), "overwrite", f"{old}_new", path=f"{self.path}/v{version}")
        self.spark.sql(f"DROP TABLE {old}_new")
        self._store({"buckets": self.buckets, "version": version})
        self._register(version)
        self.spark.sql(f"DROP TABLE {old}")
        fs.delete(self._fs(f"v{version - 1}")[1], True)

    def close(self) -> None:
        """Take the index out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _pairs(d: DataFrame) -> DataFrame:
    """(digest, doc_id, m): the rows of each digest and id."""
    return d.where(F.col("digest").isNotNull()).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("m"))


def _winners(pairs: DataFrame) -> DataFrame:
    """Per digest the lowest doc_id, rows of that pair, and rows in all."""
    return pairs.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("m").alias("m"))).alias("w"),
        F.sum("m").alias("n"),
    )


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row (doc_id, first_doc_id, copy) per row of docs.

    first_doc_id is the document that stays for this text, from the index if the text was
    there already; copy says that it is another one. Text never enters a shuffle: only
    digests and ids do.
    """
    ship(docs.sparkSession)
    d = docs.select(quoted(id_col).cast("long").alias("doc_id"), digest(quoted(text_col)).alias("digest"))
    w = _winners(_pairs(d)).select("digest", F.col("w.doc_id").alias("first_doc_id"))
    if index is not None:
        seen = index.read().select("digest", F.col("doc_id").alias("seen_doc_id"), F.lit(True).alias("seen"))
        w = w.join(seen.hint("merge"), "digest", "left").select("digest", F.when(F.col("seen"), F.col("seen_doc_id")).otherwise(F.col("first_doc_id")).alias("first_doc_id"))
    return d.join(w.withColumnRenamed("digest", "wd"), F.col("digest") == F.col("wd"), "left").select(
        "doc_id",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first_doc_id")).alias("first_doc_id"),
        (F.col("digest").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_doc_id"))).alias("copy"),
    )


def absorb(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Append the digests of docs that the index lacks, each with its lowest doc_id: a sort-merge anti-join."""
    ship(docs.sparkSession)
    w = _winners(_pairs(docs.select(quoted(id_col).cast("long").alias("doc_id"), digest(quoted(text_col)).alias("digest"))))
    new = w.join(index.read().select("digest").hint("merge"), "digest", "left_anti").select("digest", F.col("w.doc_id").alias("doc_id"))
    # written first: the index can't be read and appended to by one job
    index.append(materialize(new, "new-digests"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with their columns; new digests are appended to the index."""
    spark = docs.sparkSession
    ship(spark)
    key, dig = fresh(docs, "k_doc"), fresh(docs, "k_digest")
    full = docs.withColumns({key: quoted(id_col).cast("long"), dig: digest(quoted(text_col))})
    d = materialize(_pairs(full.select(F.col(key).alias("doc_id"), F.col(dig).alias("digest"))), "digests")
    w = materialize(_winners(d), "winners")
    if index is not None:
        fresh_w = w.join(index.read().select("digest").hint("merge"), "digest", "left_anti")
        fresh_w = materialize(fresh_w, "new-digests")
        index.append(fresh_w.select("digest", F.col("w.doc_id").alias("doc_id")))
        gone = w.join(fresh_w.select("digest"), "digest", "left_anti").select("digest")
    else:
        fresh_w, gone = w, None
    # rows to drop: the losers of each repeated digest, named by (digest, doc_id)
    multi = fresh_w.where("n > 1").select("digest", F.col("w.doc_id").alias("first"))
    losers = d.join(multi, "digest").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("digest").alias("l_digest"), F.col("doc_id").alias("l_doc"))
    losers = materialize(losers, "losers")
    losers = small_or_plain(named_apart(full, losers))
    kept = full.join(losers, (full[dig] == losers[losers.columns[0]]) & full[key].eqNullSafe(losers[losers.columns[1]]), "left_anti")
    if gone is not None:
        g = materialize(gone.select(F.col("digest").alias("g_digest")), "seen-digests")
        g = small_or_plain(named_apart(full, g))
        kept = kept.join(g, kept[dig] == g[g.columns[0]], "left_anti")
    # equal rows of a winner: only those rows are shuffled
    again = fresh_w.where("w.m > 1").select(F.col("digest").alias("a_digest"))
    again = materialize(again, "equal-rows")
    if not again.isEmpty():
        a = small_or_plain(named_apart(full, again))
        same = kept[dig] == a[a.columns[0]]
        once = kept.join(a, same, "left_anti")
        twice = kept.join(a, same, "left_semi").dropDuplicates([key, dig])
        kept = once.unionByName(twice)
    return kept.drop(key, dig)


def arrivals(docs: DataFrame, id_col: str = "doc_id") -> list[DataFrame]:
    """docs as two batches, the lower ids first and null ids last, so that a text's first arrival has its lowest id."""
    key = quoted(id_col).cast("long")
    low, high = docs.agg(F.min(key), F.max(key)).first()
    if low is None:
        return [docs]
    middle = F.lit((low + high) // 2)
    return [docs.where(key <= middle), docs.where(key.isNull() | (key > middle))]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, scratch_path(spark, "digest-index"))
    for batch in arrivals(docs):
        absorb(batch, index)
    return find_copies(docs, index=index)


SQL = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS first_doc_id,
       text IS NOT NULL AND doc_id <> min(doc_id) OVER (PARTITION BY text) AS copy
FROM documents
"""
