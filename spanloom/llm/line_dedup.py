"""Line dedup: repeated runs of lines are found by winnowing and their later copies deleted.

A run counts when its lines hold min_words words together. The shortest run of that size
that begins at a line is its window, and the least line hash of a window is selected as a
fingerprint. A fingerprint is recorded once for each place it is selected at, however many windows
share it. Equal windows select the same line, so every repeated run holds a fingerprint that is
selected at each of its places: a guarantee, not a chance. Fingerprints that are selected at one
place only in all documents end the search there.

Round the fingerprints that are met again, the match is extended both ways: by the windows that
begin at a line, to the right, and by the shortest runs that end at a line, to the left, each
joined by the fingerprint and the content of its lines. A line is covered by some repeated one of
these exactly when it lies in a repeated run. Every line of a window that occurred earlier, by
(doc_id, text hash, line), is deleted.

Only windows whose content occurs more than once are joined, to their first place and not
to each other, so a passage of a million copies makes a million rows. Text is shuffled only
if the list of deletions is too long to broadcast.

Defined results
- Lines are the parts between newlines, compared byte for byte; words are runs of characters
  other than space, tab, newline, carriage return. Lines without words belong to runs.
- A repeat within a document counts like one across documents.
- A document whose lines all go keeps its row with an empty text; null and empty texts are
  returned as they are, as are rows with a null doc_id, which take no part.
- Rows equal in doc_id and text are one document and get the same result. Rows equal in doc_id
  alone are several documents, in the order of their texts' hashes.
- A repeated passage that begins or ends inside a line is found as far as its whole lines go.
- Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm import bytesvec
from spanloom.llm.common import fresh, named_apart, quoted, ship, slices, text_bytes
from spanloom.plans.session import materialize, small_or_plain

MIN_WORDS = 50

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 13]] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, words) of each line; an empty document has one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    doc.sort()
    ends = np.append(starts[1:], len(data))
    same = np.append(doc[1:] == doc[:-1], False)
    ends = ends - same  # without the newline
    h = np.full(len(starts), np.uint64(0x1234567), np.uint64)
    full = ends > starts
    h[full] = bytesvec.word_hashes(data, starts[full], ends[full])
    solid = ~_SPACE[data]
    token = solid.copy()
    token[1:] &= ~solid[:-1]
    at = offsets[1:-1]
    at = at[at < len(data)]
    token[at] = solid[at]
    c = np.concatenate([[0], np.cumsum(token)])
    return doc, h, c[ends] - c[starts]


def _first_windows(doc: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before each line, first line, last line) of the shortest window that begins at a line."""
    n = len(words)
    c = np.concatenate([[0], np.cumsum(words)])
    q = np.searchsorted(c[1:], c[:-1] + min_words, side="left")
    ok = q < n
    ok[ok] = doc[q[ok]] == doc[ok]
    return c, np.flatnonzero(ok), q[ok]


def _least(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The least hash of each window."""
    if not len(s):
        return np.zeros(0, np.uint64)
    return np.minimum.reduceat(np.append(h, np.uint64(2**64 - 1)), np.stack([s, e + 1], 1).ravel())[::2]


def winnow(doc: np.ndarray, h: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Line numbers in the batch that some window selects: the last one with its least hash."""
    _, s, e = _first_windows(doc, words, min_words)
    if not len(s):
        return s
    kinds, code = np.unique(h, return_inverse=True)
    n = len(h)
    at = np.sort(code * n + np.arange(n))
    last = np.searchsorted(at, np.searchsorted(kinds, _least(h, s, e)) * n + e, side="right") - 1
    return np.unique(at[last] % n)


def windows(doc: np.ndarray, h: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(first line, last line, fingerprint, content hash) of each window, by line number in the batch.

    The fingerprint is that of the shortest window that begins at the same line.
    """
    n = len(h)
    c, p, q = _first_windows(doc, words, min_words)
    back = np.searchsorted(c, c[1:] - min_words, side="right") - 1
    ends = np.flatnonzero(back >= 0)
    ends = ends[doc[back[ends]] == doc[ends]]
    spans = np.unique(np.concatenate([p * n + q, back[ends] * n + ends]))
    s, e = spans // n, spans % n
    if not len(s):
        z = np.zeros(0, np.uint64)
        return s, e, z, z
    least = np.zeros(n, np.uint64)
    least[p] = _least(h, p, q)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)])
    content = bytesvec.mix((total[e + 1] - total[s]) * _powers(_INVERSE, n)[s] + (e - s + 1).astype(np.uint64))
    return s, e, least[s], content


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("th"), quoted(text_col).alias("text"))
    return d.where("doc_id IS NOT NULL AND text IS NOT NULL")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(fp): the fingerprints that are selected at more than one place, counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(0)):
                doc, h, words = lines(*text_bytes(b.column(0).slice(lo, hi - lo)))
                fp, places = np.unique(h[winnow(doc, h, words, min_words)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(places)], names=["fp", "places"])

    found = _named(docs, id_col, text_col).select("text").mapInArrow(run, "fp long, places long")
    return found.groupBy("fp").agg(F.sum("places").alias("places")).where("places > 1").select("fp")


def window_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc_id, th, s, e, fp, content) of all windows; th is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2)):
                part = b.slice(lo, hi - lo)
                doc, h, words = lines(*text_bytes(part.column(2)))
                s, e, fp, content = windows(doc, h, words, min_words)
                first = np.searchsorted(doc, np.arange(part.num_rows))
                d = doc[s]
                take = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array((s - first[d]).astype(np.int32)), pa.array((e - first[d]).astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["doc_id", "th", "s", "e", "fp", "content"],
                )

    return _named(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, s int, e int, fp long, content long")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, runs): per document the disjoint (s, e) runs of lines to delete, in order."""
    ship(docs.sparkSession)
    again = small_or_plain(materialize(fingerprints(docs, id_col, text_col, min_words), "fingerprints"))
    win = materialize(window_table(docs, id_col, text_col, min_words).join(again, "fp", "left_semi"), "windows")
    place = F.struct("doc_id", "th", "s")
    first = win.groupBy("fp", "content").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", "content", "f")
    later = win.join(first, ["fp", "content"]).where(place > F.col("f")).select("doc_id", "th", "s", "e")
    w = W.partitionBy("doc_id", "th").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = later.withColumn("new", F.coalesce(F.col("s") > reach + 1, F.lit(True)).cast("int"))
    runs = cut.withColumn("run", F.sum("new").over(w)).groupBy("doc_id", "th", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))


def _without(text, runs):
    """text without the lines of runs; every expression is evaluated once."""

    def cut(x):
        size = F.size(x["runs"])

        def keep(i):
            a = F.when(i == 0, F.lit(1)).otherwise(F.element_at(x["runs"], F.greatest(i, F.lit(1)))["e"] + 2)
            b = F.when(i == size, F.size(x["ls"]) + 1).otherwise(F.element_at(x["runs"], F.least(i + 1, size))["s"] + 1)
            return F.slice(x["ls"], a, F.greatest(b - a, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), size), keep)), "\n")

    return F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("ls"), runs.alias("runs"))), cut)[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, count_as: str = "lines_removed") -> DataFrame:
    """docs with the later repeated runs cut out of the text, and the number of lines removed."""
    runs = repeated_runs(docs, id_col, text_col, min_words).select(F.col("doc_id").alias("r_doc"), F.col("th").alias("r_th"), F.col("runs").alias("r_runs"))
    runs = materialize(runs, "runs")
    key, th = fresh(docs, "k_doc"), fresh(docs, "k_th")
    full = docs.withColumns({key: quoted(id_col).cast("long"), th: F.xxhash64(quoted(text_col))})
    runs = named_apart(full, runs)
    doc, r_th, cut = runs.columns
    runs = small_or_plain(runs)
    got = full.join(runs, (full[key] == runs[doc]) & (full[th] == runs[r_th]), "left")
    removed = F.coalesce(F.aggregate(cut, F.lit(0), lambda a, r: a + r["e"] - r["s"] + 1), F.lit(0)).cast("long")
    text = F.when(F.col(cut).isNull(), quoted(text_col)).otherwise(_without(quoted(text_col), F.col(cut)))
    return got.withColumns({text_col: text, fresh(docs, count_as): removed}).drop(key, th, doc, r_th, cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before
  FROM (SELECT *, len(regexp_extract_all(line, '[^ \\n\\t\\r]+')) AS n FROM l)
), f AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto >= a.before + {MIN_WORDS} GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c b JOIN c a ON a.doc_id = b.doc_id AND a.i <= b.i AND a.before <= b.upto - {MIN_WORDS} GROUP BY b.doc_id, b.i
), w AS (
  SELECT doc_id, s, e, list_slice(string_split(text, chr(10)), s + 1, e + 1) AS content FROM f JOIN documents USING (doc_id)
), r AS (
  SELECT *, min((doc_id, s)) OVER (PARTITION BY content) AS first FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM r WHERE (doc_id, s) > first
)
SELECT d.doc_id, any_value(coalesce(k.text, CASE WHEN d.text IS NULL THEN NULL ELSE '' END)) AS text, count(gone.i) AS lines_removed
FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id) k USING (doc_id)
LEFT JOIN gone USING (doc_id)
GROUP BY d.doc_id
"""
