"""The queries of the span operators over the test tables, each with its SQL beside it.

Every query reads its whole tables. Large results are given by checksums of their rows, labels
included: 256 parts by the first byte of a row's MD5, with the number of rows and the sum of the
next four bytes. A row that is missing, doubled or labelled wrongly changes its part.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import annotate, concordance, counting, diversity, lengths, rendering, segmenters
from spanloom.operators.contain import contained_sequences, contains
from spanloom.operators.segmentation import Segmentation
from spanloom.operators.table import CrossTab
from spanloom.plans.jobs import run_cancellable
from spanloom.plans.session import scratch_path, ship
from spanloom.sources import corpus
from spanloom.sources.corpus import from_dataframe, from_texts
from spanloom.streaming.counts import stream_counts

Query = Callable[[SparkSession, str], DataFrame]

WORD, LINE, SENTENCE, NUMBER = r"[\p{L}\p{N}_]+", r"[^\n]+", r"[.!?]+", r"^[0-9]+$"
PAIR = r"(\p{L}+), (\p{L}+)"
TEMPLATE = "%(__num__)s|%(lang)s|%(nokey)s|%(__start__)s-%(__end__)s"

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- inputs -----------------------------------------------------------------------------


def docs(spark: SparkSession, d: str) -> Segmentation:
    return from_dataframe(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", ["lang", "source"])


def words(spark: SparkSession, d: str) -> Segmentation:
    return segmenters.tokenize(docs(spark, d), [(WORD, "tokenize")], label="words")


def lines(spark: SparkSession, d: str) -> Segmentation:
    return segmenters.tokenize(docs(spark, d), [(LINE, "tokenize")], label="lines")


def pages(spark: SparkSession, d: str) -> Segmentation:
    return from_dataframe(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "html")


def _tokens(name: str, pattern: str, table: str = "documents", key: str = "doc_id", text: str = "text", extra: str = ", lang, source") -> str:
    return f"""
{name}0 AS (SELECT {key}{extra}, regexp_extract_all({text}, '{pattern}') AS ts, string_split_regex({text}, '{pattern}') AS gs FROM {table} WHERE {text} IS NOT NULL),
{name}1 AS (SELECT {key}{extra}, unnest(ts) AS item, unnest(gs[1:len(ts)]) AS gap, unnest(range(len(ts))) AS i FROM {name}0),
{name} AS (SELECT {key}{extra}, i, item, CAST(sum(len(gap)) OVER p + sum(len(item)) OVER p - len(item) AS BIGINT) AS s, CAST(sum(len(gap)) OVER p + sum(len(item)) OVER p AS BIGINT) AS e,
  row_number() OVER (ORDER BY {key}, i) - 1 AS ord FROM {name}1 WINDOW p AS (PARTITION BY {key} ORDER BY i))"""


TOK, LIN = _tokens("tok", WORD), _tokens("lin", LINE)
_UNNEST = "(SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '" + WORD + "')) AS item FROM documents)"


def checksum(df: DataFrame, *cols: str) -> DataFrame:
    """(part, n, digest) of rows of whole numbers, strings and booleans."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in cols)))
    ship(df.sparkSession)
    sums = df.select(F.substring(h, 1, 10).alias("h")).mapInArrow(_digit_sums, "part string, n long, digest long")
    return sums.groupBy("part").agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))


def _digit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of rows of each first two hex digits of ten, and the sum of the other eight, by batch."""
    for b in batches:
        text = b.column(0)
        if not len(text):
            continue
        first = text.offset
        ends = np.frombuffer(text.buffers()[1], np.int32)
        raw = np.frombuffer(text.buffers()[2], np.uint8)[ends[first] : ends[first + len(text)]].reshape(-1, 10)
        digits = ((raw & 15) + 9 * (raw > 57)).astype(np.int64)
        part, rest = digits[:, 0] * 16 + digits[:, 1], digits[:, 2:] @ (16 ** np.arange(7, -1, -1))
        n, low, high = np.bincount(part, minlength=256), np.bincount(part, rest & 0xFFFF, 256), np.bincount(part, rest >> 16, 256)
        on = np.flatnonzero(n)
        sums = (high[on].astype(np.int64) << 16) + low[on].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([f"{p:02x}" for p in on]), pa.array(n[on].astype(np.int64)), pa.array(sums)], names=["part", "n", "digest"])


def _checksum_sql(ctes: str, rows: str, *cols: str) -> str:
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols)
    return f"WITH {ctes}, rows_ AS ({rows}), h_ AS (SELECT md5(concat_ws('|', {parts})) AS h FROM rows_) SELECT substr(h, 1, 2) AS part, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 3, 8) AS BIGINT)) AS BIGINT) AS digest FROM h_ GROUP BY 1"


def _r(c: str | Column) -> Column:
    return F.round(c, 6)


# --- tokenizing -------------------------------------------------------------------------


@query(f"SELECT lang AS row_id, item AS col_id, count(*) AS value FROM {_UNNEST} GROUP BY 1, 2")
def count_by_lang(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return counting.count_in_context(segmenters.tokenize(x, [(WORD, "tokenize")]), x, context_key="lang").df


_SPAN = ("doc_id", "start", "end", "content")


def _spans(seg: Segmentation, *extra: Column) -> DataFrame:
    return seg.df.select(F.col("str_index").alias("doc_id"), "start", "end", "content", *extra)


@query(_checksum_sql(TOK, "SELECT * FROM tok", "doc_id", "s", "e", "item"))
def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    return checksum(_spans(words(spark, d)), *_SPAN)


@query(_checksum_sql(TOK, "SELECT * FROM tok", "ord", "doc_id", "s", "item"))
def tokenize_ordered(spark: SparkSession, d: str) -> DataFrame:
    return checksum(words(spark, d).ordered.select("ord", F.col("str_index").alias("doc_id"), "start", "content"), "ord", "doc_id", "start", "content")


@query(f"WITH {LIN} SELECT doc_id, s AS \"start\", e AS \"end\", md5(item) AS content FROM lin")
def tokenize_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).df.select(F.col("str_index").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("content").alias("content"))


@query(_checksum_sql(
    f"""s0 AS (SELECT doc_id, string_split_regex(text, '{SENTENCE}') AS ps, list_concat(regexp_extract_all(text, '{SENTENCE}'), ['']) AS seps FROM documents WHERE text IS NOT NULL),
s1 AS (SELECT doc_id, unnest(ps) AS item, unnest(seps) AS sep, unnest(range(len(ps))) AS i FROM s0),
s2 AS (SELECT doc_id, item, CAST(sum(len(item) + len(sep)) OVER (PARTITION BY doc_id ORDER BY i) - len(item) - len(sep) AS BIGINT) AS s FROM s1)""",
    "SELECT doc_id, s, s + len(item) AS e, item FROM s2 WHERE item <> ''", "doc_id", "s", "e", "item",
))
def tokenize_split(spark: SparkSession, d: str) -> DataFrame:
    return checksum(_spans(segmenters.tokenize(docs(spark, d), [(SENTENCE, "split")])), *_SPAN)


@query(f"""SELECT l AS "left", r AS "right", count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{PAIR}', 1)) AS l, unnest(regexp_extract_all(text, '{PAIR}', 2)) AS r FROM documents) GROUP BY 1, 2""")
def tokenize_backref(spark: SparkSession, d: str) -> DataFrame:
    seg = segmenters.tokenize(docs(spark, d), [(PAIR, "tokenize", {"left": "&1", "right": "&2"})], import_annotations=False)
    return seg.df.groupBy(F.col("annotations")["left"].alias("left"), F.col("annotations")["right"].alias("right")).agg(F.count(F.lit(1)).alias("n"))


_NUM = _tokens("num", "[0-9]+")


@query(_checksum_sql(
    f"""{TOK}, {_NUM}, u AS (SELECT doc_id, s, e, 'word' AS kind, NULL AS digits FROM tok UNION ALL SELECT doc_id, s, e, 'number', 'yes' FROM num)""",
    "SELECT doc_id, s, e, CASE WHEN bool_or(kind = 'number') THEN 'number' ELSE 'word' END AS kind, max(digits) AS digits FROM u GROUP BY 1, 2, 3", "doc_id", "s", "e", "kind", "digits",
))
def tokenize_multi_regex_merge(spark: SparkSession, d: str) -> DataFrame:
    seg = segmenters.tokenize(docs(spark, d), [(WORD, "tokenize", {"kind": "word"}), ("[0-9]+", "tokenize", {"kind": "number", "digits": "yes"})], import_annotations=False, merge=True)
    a = F.col("annotations")
    return checksum(_spans(seg, a["kind"].alias("kind"), a["digits"].alias("digits")), "doc_id", "start", "end", "kind", "digits")


@query(_checksum_sql(f"{TOK}, {_NUM}, u AS (SELECT doc_id, s, e, 0 AS k FROM tok UNION ALL SELECT doc_id, s, e, 1 FROM num)", "SELECT *, row_number() OVER (ORDER BY doc_id, s, e, k) - 1 AS ord FROM u", "ord", "doc_id", "s", "e"))
def tokenize_multi_regex(spark: SparkSession, d: str) -> DataFrame:
    seg = segmenters.tokenize(docs(spark, d), [(WORD, "tokenize"), ("[0-9]+", "tokenize")])
    return checksum(seg.ordered.select("ord", F.col("str_index").alias("doc_id"), "start", "end"), "ord", "doc_id", "start", "end")


# --- filters ----------------------------------------------------------------------------


def _two(kept: Segmentation, rest: Segmentation) -> DataFrame:
    """Every span with the half it is in."""
    both = _spans(kept, F.lit("kept").alias("half")).unionByName(_spans(rest, F.lit("rest").alias("half")))
    return checksum(both, "half", *_SPAN)


def _two_sql(cond: str, ctes: str = "") -> str:
    return _checksum_sql(TOK + ctes, f"SELECT CASE WHEN {cond} THEN 'kept' ELSE 'rest' END AS half, * FROM tok", "half", "doc_id", "s", "e", "item")


@query(_two_sql("regexp_matches(item, 'ing$')"))
def select_include(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.select(words(spark, d), "ing$"))


@query(_two_sql("NOT regexp_matches(item, '^[A-Z]')"))
def select_exclude(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.select(words(spark, d), "^[A-Z]", "exclude"))


@query(_two_sql("regexp_matches(lang, '^(en|de)$')"))
def select_by_annotation(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.select(words(spark, d), "^(en|de)$", annotation_key="lang"))


_FREQ = ", f AS (SELECT item AS k, count(*) AS n FROM tok GROUP BY 1)"


@query(_two_sql("item IN (SELECT k FROM f WHERE n >= 100)", _FREQ))
def threshold_min(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.threshold(words(spark, d), 100))


@query(_two_sql("item IN (SELECT k FROM f WHERE n BETWEEN 5 AND 50)", _FREQ))
def threshold_range(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.threshold(words(spark, d), 5, 50))


@query(_two_sql("source IN (SELECT source FROM g WHERE n >= 20000)", ", g AS (SELECT source, count(*) AS n FROM tok GROUP BY 1)"))
def threshold_annotation(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.threshold(words(spark, d), 20000, annotation_key="source"))


@query(_checksum_sql(f"{TOK}, k AS (SELECT greatest(1, CAST(round_even(count(*) / 5000.0, 0) AS BIGINT)) AS step FROM tok)", "SELECT CASE WHEN ord % step = 0 THEN 'kept' ELSE 'rest' END AS half, tok.* FROM tok, k", "half", "doc_id", "s", "e", "item"))
def sample_systematic(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.sample(words(spark, d), 5000, "systematic"))


@query(f"SELECT least(count(*), 5000) AS kept, greatest(count(*) - 5000, 0) AS rest FROM {_UNNEST}")
def sample_random(spark: SparkSession, d: str) -> DataFrame:
    kept, rest = segmenters.sample(words(spark, d), 5000, "random")
    return kept.df.agg(F.count(F.lit(1)).alias("kept")).crossJoin(rest.df.agg(F.count(F.lit(1)).alias("rest")))


_BENCH = f", b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS k FROM benchmark)"


def _benchmark_words(spark: SparkSession, d: str) -> Segmentation:
    return segmenters.tokenize(from_dataframe(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text"), [(WORD, "tokenize")])


@query(_two_sql("item IN (SELECT k FROM b)", _BENCH))
def intersect_include(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.intersect(words(spark, d), _benchmark_words(spark, d)))


@query(_two_sql("item NOT IN (SELECT k FROM b)", _BENCH))
def intersect_exclude(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.intersect(words(spark, d), _benchmark_words(spark, d), mode="exclude"))


@query(_two_sql("lang IN ('en', 'fr')"))
def intersect_annotation(spark: SparkSession, d: str) -> DataFrame:
    return _two(*segmenters.intersect(words(spark, d), from_texts(spark, ["en", "fr", "xx"]), source_key="lang"))


@query("SELECT doc_id, lang, md5(text) AS content FROM documents WHERE text IS NOT NULL")
def bypass(spark: SparkSession, d: str) -> DataFrame:
    return segmenters.bypass(docs(spark, d)).df.select(F.col("str_index").alias("doc_id"), F.col("annotations")["lang"].alias("lang"), F.md5("content").alias("content"))


# --- combining, numbering, recoding -----------------------------------------------------

_UNION = "u AS (SELECT doc_id, s, e, 1 AS no, 'words' AS label FROM tok UNION ALL SELECT doc_id, s, e, 0, 'lines' FROM lin)"


def _labelled(seg: Segmentation) -> DataFrame:
    return seg.ordered.select("ord", F.col("annotations")["component_label"].alias("label"), F.col("str_index").alias("doc_id"), "start", "end")


_LABELLED = ("ord", "label", "doc_id", "start", "end")


@query(_checksum_sql(f"{TOK}, {LIN}, {_UNION}", "SELECT *, row_number() OVER (ORDER BY doc_id, s, e, no) - 1 AS ord FROM u", "ord", "label", "doc_id", "s", "e"))
def concatenate_labels(spark: SparkSession, d: str) -> DataFrame:
    return checksum(_labelled(segmenters.concatenate([lines(spark, d), words(spark, d)], sort=True)), *_LABELLED)


@query(_checksum_sql(
    f"""{TOK}, {LIN}, c AS (SELECT doc_id, s, e, 0 AS no, 'selected_data' AS label, row_number() OVER (ORDER BY ord) AS place FROM tok WHERE regexp_matches(item, '{NUMBER}')
UNION ALL SELECT doc_id, s, e, 1, 'lines', ord FROM lin), r AS (SELECT doc_id, min(row(no, place)) AS seen FROM c GROUP BY 1)""",
    "SELECT label, doc_id, s, e, row_number() OVER (ORDER BY seen, s, e, no) - 1 AS ord FROM c JOIN r USING (doc_id)", "ord", "label", "doc_id", "s", "e",
))
def concatenate_default_order(spark: SparkSession, d: str) -> DataFrame:
    """Strings in the order in which the inputs show them: first those that hold a number."""
    return checksum(_labelled(segmenters.concatenate([_numbers(spark, d), lines(spark, d)])), *_LABELLED)


@query(_checksum_sql(f"{TOK}, {LIN}, {_UNION}", "SELECT doc_id, s, e, max(label) AS label FROM u GROUP BY 1, 2, 3", "label", "doc_id", "s", "e"))
def concatenate_merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    both = segmenters.concatenate([lines(spark, d), words(spark, d)], merge=True)
    return checksum(both.df.select(F.col("annotations")["component_label"].alias("label"), F.col("str_index").alias("doc_id"), "start", "end"), *_LABELLED[1:])


@query(f"WITH {LIN} SELECT doc_id, s AS \"start\", ord + 1 AS number FROM lin")
def auto_number(spark: SparkSession, d: str) -> DataFrame:
    seg = segmenters.auto_number(lines(spark, d), "n")
    return seg.df.select(F.col("str_index").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("annotations")["n"].cast("long").alias("number"))


def _recoded(seg: Segmentation, **kw) -> DataFrame:
    out, _ = segmenters.recode(seg, **kw)
    return out.df.select("ord", F.md5("content").alias("content"), F.col("end").cast("long").alias("length"))


_DOC_ORD = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, text FROM documents WHERE text IS NOT NULL"


@query(f"SELECT ord, md5(lower(text)) AS content, len(lower(text)) AS length FROM ({_DOC_ORD})")
def recode_lower(spark: SparkSession, d: str) -> DataFrame:
    return _recoded(docs(spark, d), case="lower")


@query(f"SELECT ord, md5(strip_accents(text)) AS content, len(strip_accents(text)) AS length FROM ({_DOC_ORD})")
def recode_accents(spark: SparkSession, d: str) -> DataFrame:
    return _recoded(docs(spark, d), remove_accents=True)


_SUB = "regexp_replace(regexp_replace(text, '([aeiou])([nm])', '\\2\\1', 'g'), 'th', 'TH', 'g')"


@query(f"SELECT ord, md5({_SUB}) AS content, len({_SUB}) AS length FROM ({_DOC_ORD})")
def recode_substitute(spark: SparkSession, d: str) -> DataFrame:
    return _recoded(docs(spark, d), substitutions=[("([aeiou])([nm])", "&2&1"), ("th", "TH")])


@query("SELECT CAST(sum(len(regexp_extract_all(text, '[aeiou][nm]'))) AS BIGINT) AS n_replacements FROM documents")
def recode_count(spark: SparkSession, d: str) -> DataFrame:
    return segmenters.recode(docs(spark, d), [("([aeiou])([nm])", "&2&1")])[1]


@query(f"""WITH {TOK}, {LIN}, {_UNION}, o AS (SELECT doc_id, s, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u)
SELECT doc_id, count(*) AS overlapping FROM o WHERE s < reach GROUP BY 1""")
def overlap_check(spark: SparkSession, d: str) -> DataFrame:
    both = segmenters.concatenate([lines(spark, d), words(spark, d)], sort=True, import_labels_as=None)
    return both.overlaps().groupBy(F.col("str_index").alias("doc_id")).agg(F.count(F.lit(1)).alias("overlapping"))


@query("SELECT unnest(['lang', 'source']) AS annotation_key")
def annotation_keys(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).annotation_keys()


# --- markup -----------------------------------------------------------------------------


def _elements(seg: Segmentation, *ann: str) -> DataFrame:
    return seg.df.select(F.col("str_index").alias("page_id"), F.md5("content").alias("content"), *(F.col("annotations")[a].alias(a) for a in ann))


@query("""SELECT page_id, md5(item) AS content, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 2, 's')) AS item,
unnest(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1, 's')) AS href FROM pages) WHERE item <> ''""")
def xml_links(spark: SparkSession, d: str) -> DataFrame:
    return _elements(segmenters.import_xml(pages(spark, d), "a"), "href")


@query("""SELECT page_id, md5(item) AS content, 'article' AS el FROM (SELECT page_id, unnest(regexp_extract_all(html, '<article>(.*?)</article>', 1, 's')) AS item FROM pages) WHERE item <> ''""")
def xml_articles(spark: SparkSession, d: str) -> DataFrame:
    return _elements(segmenters.import_xml(pages(spark, d), "article", import_element_as="el"), "el")


@query("""WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1, 's')) AS body FROM pages),
p AS (SELECT page_id, unnest(string_split_regex(body, '<[^>]+>')) AS item FROM li) SELECT page_id, md5(item) AS content FROM p WHERE item <> ''""")
def xml_remove_markup(spark: SparkSession, d: str) -> DataFrame:
    return _elements(segmenters.import_xml(pages(spark, d), "li", remove_markup=True))


@query("""SELECT page_id, md5(item) AS content, "class" FROM (SELECT page_id, unnest(regexp_extract_all(html, '<div class="([^"]*)">(.*?)</div>', 2, 's')) AS item,
unnest(regexp_extract_all(html, '<div class="([^"]*)">(.*?)</div>', 1, 's')) AS "class" FROM pages) WHERE item <> '' AND regexp_matches("class", '^a')""")
def xml_condition(spark: SparkSession, d: str) -> DataFrame:
    return _elements(segmenters.import_xml(pages(spark, d), "div", conditions={"class": "^a"}), "class")


# --- counting ---------------------------------------------------------------------------


@query(f"SELECT '__global__' AS row_id, item AS col_id, count(*) AS value FROM {_UNNEST} GROUP BY 2")
def count_global(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_in_context(words(spark, d)).df


_INSIDE = "i_ AS (SELECT t.*, l.ord AS line, l.item AS line_text FROM tok t JOIN lin l ON t.doc_id = l.doc_id AND t.s >= l.s AND t.e <= l.e)"


@query(f"WITH {TOK}, {LIN}, {_INSIDE} SELECT source AS row_id, item AS col_id, count(*) AS value FROM i_ GROUP BY 1, 2")
def count_word_in_line(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_in_context(words(spark, d), lines(spark, d), context_key="source").df


@query(_checksum_sql(
    f"{TOK}, {LIN}, {_INSIDE}, g AS (SELECT line, ord, item || ' ' || lead(item) OVER w AS gram, lead(ord) OVER w - ord AS gap FROM i_ WINDOW w AS (PARTITION BY line ORDER BY ord))",
    "SELECT line, ord, gram FROM g WHERE gap = 1", "line", "ord", "gram",
))
def contained_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of words that follow each other inside a line, with both ordinals."""
    w = words(spark, d)
    rows = contained_sequences(w, lines(spark, d), 2, w.item(), {})
    return checksum(rows.select("ctx_ord", "u_ord", F.array_join("items", " ").alias("gram")), "ctx_ord", "u_ord", "gram")


@query(f"WITH {LIN} SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside FROM lin")
def contains_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Every line lies inside its document, none reaches out of it."""
    inner = lines(spark, d).df.select(*(F.col(c).alias(f"i_{c}") for c in ("str_index", "start", "end")))
    j = docs(spark, d).df.join(inner, F.col("str_index") == F.col("i_str_index"))
    return j.agg(F.count_if(contains()).alias("n"), F.count_if(~contains()).alias("outside"))


@query(f"WITH {TOK}, {LIN}, {_INSIDE} SELECT '__global__' AS row_id, lang AS col_id, count(*) AS value FROM i_ GROUP BY 2")
def count_merged(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_in_context(words(spark, d), lines(spark, d), unit_key="lang", merge_contexts=True).df


_CELL = ("row_id", "col_id", "value")


def _cells(t: CrossTab) -> DataFrame:
    return checksum(t.df, *_CELL)


def _grams(n: int, delim: str = "#", over: str = "ORDER BY ord") -> str:
    parts = f" || '{delim}' || ".join(["item"] + [f"lead(item, {k}) OVER w" for k in range(1, n)])
    return f"(SELECT *, {parts} AS gram FROM tok WINDOW w AS ({over}))"


@query(_checksum_sql(TOK, f"SELECT '__global__' AS row_id, gram AS col_id, count(*) AS value FROM {_grams(2)} WHERE gram IS NOT NULL GROUP BY 2", *_CELL))
def count_bigram_global(spark: SparkSession, d: str) -> DataFrame:
    return _cells(counting.count_in_context(words(spark, d), seq_length=2))


@query(_checksum_sql(
    f"{TOK}, {LIN}, {_INSIDE}, g AS (SELECT lang, item || '#' || lead(item) OVER w || '#' || lead(item, 2) OVER w AS gram, lead(ord, 2) OVER w - ord AS gap FROM i_ WINDOW w AS (PARTITION BY line ORDER BY ord))",
    "SELECT lang AS row_id, gram AS col_id, count(*) AS value FROM g WHERE gap = 2 GROUP BY 1, 2", *_CELL,
))
def count_trigram_in_line(spark: SparkSession, d: str) -> DataFrame:
    return _cells(counting.count_in_context(words(spark, d), lines(spark, d), seq_length=3, context_key="lang"))


def _windows_sql(w: int, n: int = 1) -> str:
    src = "tok" if n == 1 else f"(SELECT *, gram AS g FROM {_grams(n)} WHERE gram IS NOT NULL)"
    item = "item" if n == 1 else "g"
    return f"SELECT win, {item} AS unit, count(*) AS value FROM (SELECT {item}, unnest(range(greatest(0, ord + {n} - {w}), least(ord, (SELECT count(*) FROM tok) - {w}) + 1)) AS win FROM {src}) GROUP BY 1, 2"


@query(_checksum_sql(TOK, _windows_sql(4), "win + 1", "unit", "value"))
def count_window(spark: SparkSession, d: str) -> DataFrame:
    return _cells(counting.count_in_window(words(spark, d), 4))


@query(_checksum_sql(TOK, _windows_sql(4, 2), "win + 1", "unit", "value"))
def count_window_bigram(spark: SparkSession, d: str) -> DataFrame:
    return _cells(counting.count_in_window(words(spark, d), 4, seq_length=2))


def _chain_sql(left: int, right: int, n: int = 1, merge: bool = False) -> str:
    items = ["item"] + [f"lead(item, {k}) OVER w" for k in range(1, left + n + right)]
    joined = lambda xs: " || '#' || ".join(xs) if xs else "''"
    over = "ORDER BY ord" if merge else "PARTITION BY doc_id ORDER BY i"
    rows = f"SELECT {joined(items[:left])} || '_' || {joined(items[left + n:])} AS row_id, {joined(items[left:left + n])} AS col_id FROM tok WINDOW w AS ({over})"
    return _checksum_sql(TOK, f"SELECT row_id, col_id, count(*) AS value FROM ({rows}) WHERE row_id IS NOT NULL AND col_id IS NOT NULL GROUP BY 1, 2", *_CELL)


@query(_chain_sql(1, 0))
def chain_left1(spark: SparkSession, d: str) -> DataFrame:
    return _cells(counting.count_in_chain(words(spark, d)))


@query(_chain_sql(1, 1))
def chain_left1_right1(spark: SparkSession, d: str) -> DataFrame:
    return _cells(counting.count_in_chain(words(spark, d), 1, 1))


@query(_chain_sql(1, 1, 1, True))
def chain_merge_strings(spark: SparkSession, d: str) -> DataFrame:
    return _cells(counting.count_in_chain(words(spark, d), 1, 1, merge_strings=True))


@query(_chain_sql(2, 0, 2))
def chain_bigram(spark: SparkSession, d: str) -> DataFrame:
    return _cells(counting.count_in_chain(words(spark, d), 2, 0, seq_length=2))


# --- lengths ----------------------------------------------------------------------------

_PER_LINE = f"c_ AS (SELECT doc_id, lang, ord, CAST(len(regexp_extract_all(item, '{WORD}')) AS BIGINT) AS n FROM lin)"


@query(f"SELECT lang AS context, count(*) AS length FROM {_UNNEST} GROUP BY 1")
def length_in_context(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return lengths.length_in_context(segmenters.tokenize(x, [(WORD, "tokenize")]), contexts=x, context_key="lang")


@query(f"WITH {TOK}, {LIN}, {_INSIDE} SELECT '__global__' AS context, count(*) AS length FROM i_")
def length_merged(spark: SparkSession, d: str) -> DataFrame:
    return lengths.length_in_context(words(spark, d), contexts=lines(spark, d), merge_contexts=True)


@query(f"WITH {LIN}, {_PER_LINE} SELECT lang AS context, round(avg(n), 6) AS length_average, count(*) AS length_count, round(stddev_pop(n), 6) AS length_std_deviation FROM c_ GROUP BY 1 HAVING avg(n) > 0")
def length_average(spark: SparkSession, d: str) -> DataFrame:
    t = lengths.length_in_context(words(spark, d), lines(spark, d), docs(spark, d), context_key="lang", std_deviation=True)
    return t.withColumns({"length_average": _r("length_average"), "length_std_deviation": _r("length_std_deviation")})


@query(f"""WITH {LIN}, {_PER_LINE}, w_ AS (SELECT ord + 1 AS context, avg(n) OVER w AS a, count(*) OVER w AS k, avg(n * n) OVER w AS q FROM c_ WINDOW w AS (ORDER BY ord ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT context, round(a, 6) AS length_average, k AS length_count, round(sqrt(greatest(q - a * a, 0)), 4) AS length_std_deviation FROM w_ WHERE k = 10""")
def length_window(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    t = lengths.length_in_window(segmenters.tokenize(x, [(WORD, "tokenize")]), x, 10, True)
    return t.withColumns({"length_average": _r("length_average"), "length_std_deviation": F.round("length_std_deviation", 4)})


# --- diversity --------------------------------------------------------------------------

_FCU = f"f AS (SELECT lang AS context, source AS cat, item, count(*) AS n FROM {_UNNEST} GROUP BY 1, 2, 3), fu AS (SELECT context, item, sum(n) AS n FROM f GROUP BY 1, 2)"
_PERP = "exp(ln(sum(n)) - sum(n * ln(n)) / sum(n))"


def _variety(spark: SparkSession, d: str, **kw) -> DataFrame:
    x = docs(spark, d)
    t = diversity.variety_in_context(segmenters.tokenize(x, [(WORD, "tokenize")]), x, context_key="lang", **kw)
    return t.select("context", *(_r(c).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes if c != "context"))


@query(f"WITH {_FCU} SELECT context, CAST(count(*) AS DOUBLE) AS variety FROM fu GROUP BY 1")
def variety(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d)


@query(f"WITH {_FCU} SELECT context, round({_PERP}, 6) AS variety FROM fu GROUP BY 1")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d, weighting=True)


@query(f"WITH {_FCU} SELECT context, round(count(*) / count(DISTINCT cat), 6) AS variety FROM f GROUP BY 1")
def variety_per_category(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d, per_category=True, category_key="source")


@query(f"WITH {_FCU}, c AS (SELECT context, cat, count(*) AS v, sum(n) AS w FROM f GROUP BY 1, 2) SELECT context, round(sum(v * w) / sum(w), 6) AS variety FROM c GROUP BY 1")
def variety_category_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d, per_category=True, category_key="source", category_weighting=True)


@query(f"WITH {_FCU}, c AS (SELECT context, cat, {_PERP} AS v, sum(n) AS w FROM f GROUP BY 1, 2) SELECT context, round(sum(v * w) / sum(w), 6) AS variety FROM c GROUP BY 1")
def variety_both_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d, per_category=True, category_key="source", category_weighting=True, weighting=True)


@query(f"""WITH {_FCU}, t AS (SELECT context, CAST(sum(n) AS BIGINT) AS total FROM fu GROUP BY 1),
k AS (SELECT context, CAST(n AS BIGINT) AS n, count(*) AS m FROM fu GROUP BY 1, 2)
SELECT context, round(sum(m * (1 - CASE WHEN n > total - 1000 THEN 0 ELSE list_product(list_transform(range(least(n, 1000)), lambda i: (total - greatest(n, 1000) - i) / (total - i)::DOUBLE)) END)), 4) AS expected_variety
FROM k JOIN t USING (context) WHERE total >= 1000 GROUP BY 1""")
def expected_variety(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d, resample=True, subsample_size=1000).withColumn("expected_variety", F.round("expected_variety", 4))


def _per_window(t: DataFrame, measure: str) -> DataFrame:
    return checksum(t.select("context", F.round(F.col(measure) * 1000).cast("long").alias("v")), "context", "v")


def _window_variety_sql(size: int, measure: str, ctes: str = "") -> str:
    rows = f"SELECT win + 1 AS context, CAST(round({measure} * 1000) AS BIGINT) AS v FROM w_ GROUP BY 1"
    return _checksum_sql(f"{TOK}, w_ AS ({_windows_sql(size)}){ctes}", rows, "context", "v")


@query(_window_variety_sql(8, "count(*)"))
def variety_window(spark: SparkSession, d: str) -> DataFrame:
    return _per_window(diversity.variety_in_window(words(spark, d), 8), "variety")


@query(_window_variety_sql(6, "exp(ln(sum(value)) - sum(value * ln(value)) / sum(value))"))
def variety_window_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _per_window(diversity.variety_in_window(words(spark, d), 6, weighting=True), "variety")


@query(_checksum_sql(
    f"""{TOK}, c_ AS (SELECT win, lang, count(*) AS n, count(DISTINCT item) AS v FROM (SELECT lang, item, unnest(range(greatest(0, ord + 1 - 5), least(ord, (SELECT count(*) FROM tok) - 5) + 1)) AS win FROM tok) GROUP BY 1, 2)""",
    "SELECT win + 1 AS context, CAST(round(sum(v * n) / sum(n) * 1000) AS BIGINT) AS v FROM c_ GROUP BY 1", "context", "v",
))
def variety_window_category(spark: SparkSession, d: str) -> DataFrame:
    t = diversity.variety_in_window(words(spark, d), 5, per_category=True, category_key="lang", category_weighting=True)
    return _per_window(t, "variety")


@query(_window_variety_sql(4, "sum(CASE value WHEN 1 THEN 0.5 WHEN 2 THEN 5 / 6.0 ELSE 1 END)"))
def variety_window_expected(spark: SparkSession, d: str) -> DataFrame:
    """Types to expect in two of a window's four words: 1 - C(4 - f, 2) / C(4, 2) for each."""
    return _per_window(diversity.variety_in_window(words(spark, d), 4, resample=True, subsample_size=2), "expected_variety")


@query("SELECT 'ValueError' AS raised")
def variety_category_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Diversity per category has no sequences."""
    try:
        return diversity.variety_in_context(words(spark, d), seq_length=2, per_category=True, category_key="lang")
    except ValueError as e:
        return spark.createDataFrame([(type(e).__name__,)], "raised string")


@query()
def variety_resampled(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d, weighting=True, resample=True, subsample_size=1000, num_subsamples=50)


@query()
def variety_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d, per_category=True, category_key="source", resample=True, subsample_size=500, num_subsamples=50)


# --- annotation, concordance ------------------------------------------------------------


@query(f"""WITH {TOK}, t AS (SELECT lang AS context, item, count(*) AS n, min(ord) AS seen FROM tok GROUP BY 1, 2)
SELECT context, item AS annotation FROM t QUALIFY row_number() OVER (PARTITION BY context ORDER BY n DESC, seen) = 1""")
def annotate_top(spark: SparkSession, d: str) -> DataFrame:
    return annotate.annotate_contexts(words(spark, d), docs(spark, d), context_key="lang")


@query("SELECT source AS context, string_agg(lang, '|' ORDER BY lang) AS annotation FROM (SELECT DISTINCT source, lang FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def annotate_joined_ascii(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return annotate.annotate_contexts(x, x, unit_key="lang", context_key="source", sort_order="ASCII", reverse=False, keep_only_first=False)


@query("""SELECT source AS context, string_agg(lang, '|' ORDER BY n DESC, seen) AS annotation FROM
(SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def annotate_joined_frequency(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return annotate.annotate_contexts(x, x, unit_key="lang", context_key="source", keep_only_first=False)


def _numbers(spark: SparkSession, d: str) -> Segmentation:
    return segmenters.select(words(spark, d), NUMBER)[0]


_HITS = f"h_ AS (SELECT t.doc_id, t.ord, t.item, t.lang, t.s, t.e, l.ord + 1 AS pos, l.s AS ls, l.e AS le, l.item AS text FROM tok t JOIN lin l ON t.doc_id = l.doc_id AND t.s >= l.s AND t.e <= l.e WHERE regexp_matches(t.item, '{NUMBER}'))"


def _kwic_sql(m: int | None, extra: str = "") -> str:
    lo = "ls" if m is None else f"greatest(ls, s - {m})"
    hi = "le" if m is None else f"least(le, e + {m})"
    return f"""WITH {TOK}, {LIN}, {_HITS} SELECT row_number() OVER (ORDER BY pos, ord) AS id, pos, CASE WHEN s > {lo} THEN substring(text, CAST({lo} - ls + 1 AS BIGINT), CAST(s - {lo} AS BIGINT)) END AS "left",
item AS key_segment, CASE WHEN {hi} > e THEN substring(text, CAST(e - ls + 1 AS BIGINT), CAST({hi} - e AS BIGINT)) END AS "right"{extra} FROM h_"""


@query(_kwic_sql(None))
def kwic(spark: SparkSession, d: str) -> DataFrame:
    return concordance.context(_numbers(spark, d), lines(spark, d))


@query(_kwic_sql(20))
def kwic_max_chars(spark: SparkSession, d: str) -> DataFrame:
    return concordance.context(_numbers(spark, d), lines(spark, d), max_num_chars=20)


@query(_kwic_sql(10, ", lang AS unit_annotation, lang AS context_annotation"))
def kwic_annotation(spark: SparkSession, d: str) -> DataFrame:
    return concordance.context(_numbers(spark, d), lines(spark, d), unit_key="lang", context_key="lang", max_num_chars=10)


def _neighbors_sql(merge: bool) -> str:
    over = "ORDER BY ord" if merge else "PARTITION BY doc_id ORDER BY i"
    return f"""WITH {TOK}, n_ AS (SELECT *, lag(item, 2) OVER w AS l2, lag(item) OVER w AS l1, lead(item) OVER w AS r1, lead(item, 2) OVER w AS r2 FROM tok WINDOW w AS ({over}))
SELECT row_number() OVER (ORDER BY ord) AS id, ord + 1 AS pos, l2 AS "2L", l1 AS "1L", item AS key_segment, r1 AS "1R", r2 AS "2R" FROM n_ WHERE regexp_matches(item, '{NUMBER}')"""


@query(_neighbors_sql(False))
def neighbors_2(spark: SparkSession, d: str) -> DataFrame:
    return concordance.neighbors(_numbers(spark, d), words(spark, d), max_distance=2)


@query(_neighbors_sql(True))
def neighbors_merged(spark: SparkSession, d: str) -> DataFrame:
    return concordance.neighbors(_numbers(spark, d), words(spark, d), max_distance=2, merge_strings=True)


def _collocations_sql(least: int, merge: bool) -> str:
    same = "" if merge else "AND c.doc_id = n.doc_id"
    return f"""WITH {TOK}, n_ AS (SELECT doc_id, ord FROM tok WHERE regexp_matches(item, '{NUMBER}')),
p_ AS (SELECT DISTINCT c.ord, c.item FROM n_ n, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS k) ks, tok c WHERE c.ord = n.ord + k {same}),
l_ AS (SELECT item, count(*) AS lf FROM p_ GROUP BY 1), g_ AS (SELECT item, count(*) AS gf FROM tok GROUP BY 1),
j_ AS (SELECT item, lf, gf FROM l_ JOIN g_ USING (item) WHERE gf >= {least})
SELECT item AS unit, round(log2((lf / (SELECT sum(lf) FROM j_)) / (gf / (SELECT sum(gf) FROM g_))), 6) AS mutual_info, lf AS local_freq, round(lf / (SELECT sum(lf) FROM j_), 6) AS local_prob, gf AS global_freq, round(gf / (SELECT sum(gf) FROM g_), 6) AS global_prob FROM j_"""


def _collocated(spark: SparkSession, d: str, **kw) -> DataFrame:
    t = concordance.collocations(_numbers(spark, d), words(spark, d), max_distance=3, **kw)
    return t.withColumns({c: _r(c) for c in ("mutual_info", "local_prob", "global_prob")})


@query(_collocations_sql(1, False))
def collocations(spark: SparkSession, d: str) -> DataFrame:
    return _collocated(spark, d)


@query(_collocations_sql(5, True))
def collocations_min_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _collocated(spark, d, min_frequency=5, merge_strings=True)


# --- co-occurrence ----------------------------------------------------------------------


@query(_checksum_sql(f"{TOK}, w_ AS (SELECT DISTINCT win, unit FROM ({_windows_sql(3)}))", "SELECT a.unit AS row_id, b.unit AS col_id, count(*) AS value FROM w_ a JOIN w_ b USING (win) GROUP BY 1, 2", *_CELL))
def cooc_window(spark: SparkSession, d: str) -> DataFrame:
    return _cells(concordance.cooc_in_window(words(spark, d), 3))


def _by_line(spark: SparkSession, d: str) -> tuple[Segmentation, Segmentation]:
    """All words, and lines as their contexts: a sparse table of words by words."""
    x = lines(spark, d)
    return segmenters.tokenize(x, [(WORD, "tokenize")]), x


_LINES = f"p_ AS (SELECT DISTINCT line, item FROM (SELECT line, unnest(regexp_extract_all(line, '{WORD}')) AS item FROM (SELECT unnest(regexp_extract_all(text, '{LINE}')) AS line FROM documents)))"


@query(_checksum_sql(_LINES, "SELECT a.item AS row_id, b.item AS col_id, count(*) AS value FROM p_ a JOIN p_ b USING (line) GROUP BY 1, 2", *_CELL))
def cooc_context(spark: SparkSession, d: str) -> DataFrame:
    """All words by all words, by the lines that hold both."""
    return _cells(concordance.cooc_in_context(*_by_line(spark, d)))


@query(f"WITH {TOK}, p_ AS (SELECT DISTINCT source, item FROM tok), q_ AS (SELECT DISTINCT source, lang FROM documents) SELECT b.lang AS row_id, a.item AS col_id, count(*) AS value FROM p_ a JOIN q_ b USING (source) GROUP BY 1, 2")
def cooc_two_units(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return concordance.cooc_in_context(words(spark, d), x, context_key="source", units2=x, unit2_key="lang").df


@query("""WITH p_ AS (SELECT DISTINCT n_chars, source FROM documents WHERE text IS NOT NULL), t_ AS (SELECT DISTINCT source FROM p_)
SELECT x.source AS row_id, y.source AS col_id, (SELECT count(*) FROM p_ a JOIN p_ b USING (n_chars) WHERE a.source = x.source AND b.source = y.source) AS value FROM t_ x, t_ y""")
def cooc_zeros(spark: SparkSession, d: str) -> DataFrame:
    """Sources by sources, by the lengths at which both have a document; cells without one are written as well."""
    x = from_dataframe(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", ["source", "n_chars"])
    return concordance.cooc_in_context(x, x, unit_key="source", context_key="n_chars", zeros=True).df


# --- tables -----------------------------------------------------------------------------


def _table(spark: SparkSession, d: str) -> CrossTab:
    """Words by language."""
    x = docs(spark, d)
    return counting.count_in_context(segmenters.tokenize(x, [(WORD, "tokenize")]), x, context_key="lang")


_T = f"t AS (SELECT lang AS row_id, item AS col_id, CAST(count(*) AS DOUBLE) AS v FROM {_UNNEST} GROUP BY 1, 2)"


def _rounded(t: CrossTab) -> DataFrame:
    return t.df.select("row_id", "col_id", F.round("value", 9).alias("value"))


def _normal(mode: str, norm: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(_table(spark, d).to_normalized(mode, norm))

    run.__name__ = "normalize_" + mode.lower().replace("-", "").replace("/", "_") + (f"_{norm}" if mode in ("rows", "columns", "table") else "")
    query(f"WITH {_T} SELECT row_id, col_id, round({sql}, 9) AS value FROM t")(run)


for _mode, _over in (("rows", "PARTITION BY row_id"), ("columns", "PARTITION BY col_id"), ("table", "")):
    _normal(_mode, "l1", f"v / sum(v) OVER ({_over})")
    _normal(_mode, "l2", f"v / sqrt(sum(v * v) OVER ({_over}))")
_normal("quotients", "l1", "v * sum(v) OVER () / (sum(v) OVER (PARTITION BY row_id) * sum(v) OVER (PARTITION BY col_id))")
_normal("TF-IDF", "l1", "v * ln((SELECT count(DISTINCT row_id) FROM t) / count(*) OVER (PARTITION BY col_id))")


@query(f"WITH {_T} SELECT row_id, col_id, 1 AS value FROM t")
def normalize_presence(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).to_normalized("presence/absence").df


@query(f"WITH {_T} SELECT '__document_frequency__' AS row_id, col_id, count(*) AS value FROM t GROUP BY col_id")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).to_document_frequency().df


def _association(bias: str, scale: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = counting.count_in_context(words(spark, d), docs(spark, d), unit_key="source", context_key="lang")
        return _rounded(t.to_association_matrix(bias))

    run.__name__ = f"association_{bias}"
    query(f"""WITH {TOK}, c AS (SELECT lang, source AS item, CAST(count(*) AS DOUBLE) AS f FROM tok GROUP BY 1, 2), r AS (SELECT lang, sum(f) AS rs FROM c GROUP BY 1), w AS (SELECT item, sum(f) / (SELECT sum(f) FROM c) AS w FROM c GROUP BY 1),
e AS (SELECT a.item AS x, b.item AS y, sum(a.f * b.f / rs) / (SELECT sum(f) FROM c) AS e FROM c a JOIN c b USING (lang) JOIN r USING (lang) GROUP BY 1, 2)
SELECT x AS row_id, y AS col_id, round(e / {scale}, 9) AS value FROM e JOIN w wx ON wx.item = x JOIN w wy ON wy.item = y""")(run)


for _bias, _scale in (("frequent", "1"), ("none", "sqrt(wx.w * wy.w)"), ("rare", "(wx.w * wy.w)")):
    _association(_bias, _scale)


@query()
def association_words(spark: SparkSession, d: str) -> DataFrame:
    """All words by all words over lines, summed up by row: (row_id, cells, value)."""
    w, x = _by_line(spark, d)
    t = counting.count_in_context(w, x, digest_contexts=True).to_association_matrix()
    return t.df.groupBy("row_id").agg(F.count(F.lit(1)).alias("cells"), _r(F.sum("value")).alias("value"))


@query(f"WITH {_T} SELECT col_id AS row_id, row_id AS col_id, CAST(v AS BIGINT) AS value FROM t")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).to_transposed().df


@query(f"WITH {_T} SELECT col_id AS unit, row_id AS context, CAST(v AS BIGINT) AS weight FROM t")
def weighted_flat(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).to_weighted_flat()


@query(_checksum_sql(TOK, "SELECT * FROM tok", "lang", "item"))
def flat(spark: SparkSession, d: str) -> DataFrame:
    return checksum(_table(spark, d).to_flat(), "context", "unit")


@query(f"WITH {_T} SELECT row_id, col_id, CAST(v AS BIGINT) AS value FROM t")
def flat_to_pivot(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    return CrossTab.from_weighted_flat(CrossTab.from_flat(t.to_flat()).to_weighted_flat()).df


_SMALL = "t AS (SELECT lang AS row_id, source AS col_id, count(*) AS value FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH {_SMALL}, r AS (SELECT row_id, row_number() OVER (ORDER BY max(value) FILTER (col_id = 'src0') DESC NULLS LAST, row_id DESC) - 1 AS row_order FROM t GROUP BY 1),
c AS (SELECT col_id, row_number() OVER (ORDER BY col_id) - 1 AS col_order FROM t GROUP BY 1) SELECT row_id, col_id, value, row_order, col_order FROM t JOIN r USING (row_id) JOIN c USING (col_id)""")
def sorted_table(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return counting.count_in_context(x, x, unit_key="source", context_key="lang").to_sorted("src0", reverse_rows=True).df


@query(f"SELECT item AS unit, count(*) AS value FROM {_UNNEST} GROUP BY 1")
def top_units(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_in_context(words(spark, d)).top_units()


@query("SELECT DISTINCT source AS col_id FROM documents WHERE text IS NOT NULL")
def unique_items(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return counting.count_in_context(x, x, unit_key="source", context_key="lang").copy().unique("col").select("col_id")


def _small(spark: SparkSession, d: str) -> CrossTab:
    x = docs(spark, d)
    return counting.count_in_context(x, x, unit_key="source", context_key="lang")


_DENSE = f"WITH {_SMALL}, d AS (SELECT r.row_id, c.col_id, coalesce(t.value, 0) AS value FROM (SELECT DISTINCT row_id FROM t) r CROSS JOIN (SELECT DISTINCT col_id FROM t) c LEFT JOIN t USING (row_id, col_id))"


@query(f"""{_DENSE}, l AS (SELECT row_id, string_agg(CAST(value AS VARCHAR), chr(9) ORDER BY col_id) AS vs, string_agg(col_id, chr(9) ORDER BY col_id) AS ids FROM d GROUP BY 1)
SELECT 0 AS at, '__context__' || chr(9) || min(ids) AS line FROM l UNION ALL SELECT row_number() OVER (ORDER BY row_id), row_id || chr(9) || vs FROM l""")
def render_tsv(spark: SparkSession, d: str) -> DataFrame:
    text = _small(spark, d).to_string()
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "at long, line string")


@query(f"{_DENSE} SELECT dense_rank() OVER (ORDER BY row_id) - 1 AS i, dense_rank() OVER (ORDER BY col_id) - 1 AS j, value FROM d")
def table_to_numpy(spark: SparkSession, d: str) -> DataFrame:
    m = _small(spark, d).to_numpy()
    return spark.createDataFrame([(i, j, int(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "i long, j long, value long")


@query(f"WITH {_SMALL} SELECT row_id, col_id, value FROM t")
def table_from_numpy(spark: SparkSession, d: str) -> DataFrame:
    t = _small(spark, d)
    return CrossTab.from_numpy(spark, t.row_ids(), t.col_ids(), t.to_numpy().astype("int64")).df.select("row_id", "col_id", "value")


@query(f"{_DENSE} SELECT row_id, col_id, value, 'continuous' AS role FROM d")
def table_to_ml(spark: SparkSession, d: str) -> DataFrame:
    frame, roles = _small(spark, d).to_ml()
    rows = [(r["row_id"], c, int(r[c]), roles[c]) for r in frame.to_dict("records") for c in frame.columns if c != "row_id"]
    return spark.createDataFrame(rows, "row_id string, col_id string, value long, role string")


# --- the segmentation as a container ----------------------------------------------------


def _numbered_spans(seg: Segmentation) -> DataFrame:
    return seg.ordered.select("ord", F.col("str_index").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("content").alias("content"))


_LINE_ROW = 'doc_id, s AS "start", e AS "end", md5(item) AS content'


@query(f"WITH {LIN} SELECT (ord - 7) // 5 AS ord, {_LINE_ROW} FROM lin WHERE ord >= 7 AND (ord - 7) % 5 = 0")
def get_slice(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)[7::5]
    return _numbered_spans(Segmentation(x.df.withColumnRenamed("ord", "tie"), x.label))


@query(f"WITH {LIN}, n_ AS (SELECT count(*) AS n FROM lin) SELECT ord, {_LINE_ROW} FROM lin, n_ WHERE ord IN (0, 41, n - 1)")
def get_item(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    rows = [x[k] for k in (0, 41, -1)]
    t = spark.createDataFrame([(r.ord, r.str_index, r.start, r.end, r.content) for r in rows], "ord long, doc_id long, start long, end long, content string")
    return t.withColumn("content", F.md5("content"))


@query(f"WITH {LIN} SELECT ord, doc_id, s AS \"start\", CASE WHEN ord = 3 THEN s + 4 ELSE e END AS \"end\", md5(CASE WHEN ord = 3 THEN item[:4] ELSE item END) AS content, CASE WHEN ord = 3 THEN 'short' END AS note FROM lin")
def set_item(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    at = x[3].start
    y = x.set_segment(3, at, at + 4, {"note": "short"})
    return _numbered_spans(y).join(y.ordered.select("ord", F.col("annotations")["note"].alias("note")), "ord")


@query(f"WITH {LIN} SELECT ord, doc_id, item[:3] AS head FROM lin")
def iterate(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).each(lambda rows: ((r.ord, r.str_index, r.content[:3]) for r in rows), "ord long, doc_id long, head string")


@query(f"WITH {LIN}, n_ AS (SELECT count(*) AS n FROM lin) SELECT ord, {_LINE_ROW} FROM lin UNION ALL SELECT n + row_number() OVER (ORDER BY doc_id) - 1, doc_id, 0, len(text), md5(text) FROM documents, n_ WHERE text IS NOT NULL")
def append(spark: SparkSession, d: str) -> DataFrame:
    return _numbered_spans(lines(spark, d).append(docs(spark, d)))


@query(f"""WITH {LIN}, u AS (SELECT 0 AS no, ord, doc_id, s, e, item FROM lin UNION ALL SELECT 1, doc_id, doc_id, 0, len(text), text FROM documents WHERE text IS NOT NULL)
SELECT row_number() OVER (ORDER BY doc_id, no, ord) - 1 AS ord, {_LINE_ROW} FROM u""")
def sort_by_string(spark: SparkSession, d: str) -> DataFrame:
    """The runs of an appended segmentation brought together by their strings."""
    return _numbered_spans(lines(spark, d).append(docs(spark, d)).sorted_by_string())


@query(f"WITH {LIN} SELECT doc_id, min(ord) AS first_ord FROM lin GROUP BY 1")
def string_starts(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).string_starts().select(F.col("str_index").alias("doc_id"), "first_ord")


@query("SELECT doc_id, 'xx' AS lang, source, 'yes' AS copied FROM documents WHERE text IS NOT NULL")
def deep_copy(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("annotations")
    x = docs(spark, d).copy({"lang": "xx", "copied": "yes"})
    return x.df.select(F.col("str_index").alias("doc_id"), a["lang"].alias("lang"), a["source"].alias("source"), a["copied"].alias("copied"))


@query("SELECT doc_id, md5(CASE WHEN doc_id = 5 THEN 'new text' ELSE text END) AS content FROM documents WHERE text IS NOT NULL AND doc_id <> 6")
def update_string(spark: SparkSession, d: str) -> DataFrame:
    x = corpus.update(corpus.update(docs(spark, d), 5, "new text"), 6, None)
    return x.df.select(F.col("str_index").alias("doc_id"), F.md5("content").alias("content"))


_AGAIN = 1_000_000_000


def _doubled(spark: SparkSession, d: str) -> Segmentation:
    """The documents, and a pointer to each of them."""
    x = docs(spark, d)
    return corpus.with_pointers(x, x.df.select((F.col("str_index") + _AGAIN).alias("str_index"), F.col("str_index").alias("target")))


@query(f"SELECT doc_id + k * {_AGAIN} AS str_index, doc_id AS real_str_index, len(text) AS \"end\" FROM documents, (SELECT unnest([0, 1]) AS k) WHERE text IS NOT NULL")
def pointers(spark: SparkSession, d: str) -> DataFrame:
    return _doubled(spark, d).df.select("str_index", "real_str_index", F.col("end").cast("long").alias("end"))


@query(_checksum_sql(
    f"{TOK}, t2_ AS (SELECT doc_id, i, item, k FROM tok, (SELECT unnest([0, 1]) AS k)), c_ AS (SELECT lag(item) OVER (PARTITION BY doc_id ORDER BY k, i) AS l, item FROM t2_)",
    "SELECT l || '_' AS row_id, item AS col_id, count(*) AS value FROM c_ WHERE l IS NOT NULL GROUP BY 1, 2", *_CELL,
))
def chain_pointers(spark: SparkSession, d: str) -> DataFrame:
    """Transitions go on from a string into the pointers to it."""
    return _cells(counting.count_in_chain(segmenters.tokenize(_doubled(spark, d), [(WORD, "tokenize")])))


@query(_checksum_sql(
    f"{TOK}, c_ AS (SELECT lag(item) OVER (PARTITION BY doc_id ORDER BY i) AS l, item FROM tok WHERE NOT contains(item, 'th'))",
    "SELECT l || '_' AS row_id, item AS col_id, count(*) AS value FROM c_ WHERE l IS NOT NULL GROUP BY 1, 2", *_CELL,
))
def chain_recoded(spark: SparkSession, d: str) -> DataFrame:
    """Recoded words are strings of their own; the others still follow each other, by pointers where need be."""
    return _cells(counting.count_in_chain(segmenters.recode(words(spark, d), [("th", "TH")])[0]))


@query(_checksum_sql(f"{TOK}, {LIN}, {_UNION}, o AS (SELECT u.*, lower(substring(text, s + 1, e - s)) AS item FROM u JOIN documents USING (doc_id))", "SELECT row_number() OVER (ORDER BY doc_id, s, e, no) - 1 AS ord, item FROM o", "ord", "item"))
def recode_overlapping(spark: SparkSession, d: str) -> DataFrame:
    both = segmenters.concatenate([lines(spark, d), words(spark, d)], sort=True)
    return checksum(segmenters.recode(both, case="lower", check_overlap=False)[0].df, "ord", "content")


# --- markup over several strings, nested and merged -------------------------------------

_NESTED = '<a attr="1"><a attr="2/3/">c<a/>d</a></a>'


def _marked(seg: Segmentation, *ann: str) -> DataFrame:
    a = F.col("annotations")
    return seg.ordered.select("ord", "str_index", F.col("start").cast("long").alias("start"), "content", *(a[k].alias(k) for k in ann))


@query("""SELECT * FROM (VALUES (0, 0, 12, '<a attr="2/3/">c<a/>d</a>', '1', 'a'), (1, 0, 27, 'c<a/>d', '2/3/', 'a')) t(ord, str_index, "start", content, attr, el)""")
def xml_nested(spark: SparkSession, d: str) -> DataFrame:
    return _marked(segmenters.import_xml(from_texts(spark, [_NESTED]), "a", import_element_as="el"), "attr", "el")


@query("""SELECT * FROM (VALUES (0, 0, 3, '1<a>2<a>3</a>4', 'x'), (1, 0, 7, '2<a>3</a>4', 'x'), (2, 0, 11, '3', 'x'), (3, 1, 0, '</a>5', 'y')) t(ord, str_index, "start", content, part)""")
def xml_cross_string(spark: SparkSession, d: str) -> DataFrame:
    """Elements that open in one string and close in the next; the one that ends as the second begins has no more there."""
    rows = spark.createDataFrame([(0, "<a>1<a>2<a>3</a>4", "x"), (1, "</a>5</a>", "y")], "id long, text string, part string")
    return _marked(segmenters.import_xml(from_dataframe(rows, "id", "text", ["part"]), "a"), "part")


@query("""SELECT * FROM (VALUES (0, 0, 27, 'c', '1'), (1, 0, 32, 'd', '1')) t(ord, str_index, "start", content, attr)""")
def xml_merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _marked(segmenters.import_xml(from_texts(spark, [_NESTED]), "a", remove_markup=True, merge=True), "attr")


@query("""SELECT * FROM (VALUES (0, 0, 27, 'c', '2/3/'), (1, 0, 32, 'd', '2/3/')) t(ord, str_index, "start", content, attr)""")
def xml_preserve_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _marked(segmenters.import_xml(from_texts(spark, [_NESTED]), "a", remove_markup=True, merge=True, preserve_leaves=True), "attr")


# --- running and watching ---------------------------------------------------------------


@query("SELECT true AS cancelled, false AS finished UNION ALL SELECT false, true")
def cancellation(spark: SparkSession, d: str) -> DataFrame:
    """A count that would never end is cancelled; another one ends."""
    endless = lambda: spark.range(1 << 44).selectExpr("sum(hash(id))").collect()
    j, thread, out = run_cancellable(spark, endless)
    while not j.progress().total:
        time.sleep(0.05)
    j.cancel()
    thread.join()
    k, other, ended = run_cancellable(spark, lambda: lines(spark, d).count())
    other.join()
    rows = [(j.cancelled.is_set(), out != [None]), (k.cancelled.is_set(), bool(ended[0]) and k.progress().done > 0)]
    return spark.createDataFrame(rows, "cancelled boolean, finished boolean")


# --- rendering, streaming ---------------------------------------------------------------


@query(f"WITH {LIN} SELECT ord, (ord + 1) || '|' || lang || '|__none__|' || (s + 1) || '-' || e AS line FROM lin")
def render_format(spark: SparkSession, d: str) -> DataFrame:
    return rendering.lines(lines(spark, d), TEMPLATE, humanize_addresses=True)


@query(f"""WITH {LIN} SELECT ord, md5('segment number ' || (ord + 1) || chr(10) || chr(9) || 'content:' || chr(9) || '"' || item || '"' || chr(10) || chr(9) || 'str_index:' || chr(9) || doc_id || chr(10) || chr(9) || 'start:' || chr(9) || s || chr(10) || chr(9) || 'end:' || chr(9) || e
|| chr(10) || chr(9) || 'annotations:' || chr(10) || chr(9) || chr(9) || rpad('lang', 20, ' ') || ' ' || lang || chr(10) || chr(9) || chr(9) || rpad('source', 20, ' ') || ' ' || source) AS line FROM lin""")
def render_default(spark: SparkSession, d: str) -> DataFrame:
    return rendering.lines(lines(spark, d)).withColumn("line", F.md5("line"))


@query(f"""WITH {LIN} SELECT ord, md5('<a name="' || (ord + 1) || '"/>' || chr(10) || '<table width="100%">' || chr(10) || '<tr><td class="h" colspan="2">Segment #' || (ord + 1) || '&nbsp;&nbsp;[' || (doc_id + 1) || ':' || (s + 1) || '-' || e || ']</td></tr>'
|| '<tr><td class="k">lang</td><td class="v" width="100%">' || lang || '</td></tr>' || chr(10) || '<tr><td class="k">source</td><td class="v" width="100%">' || source || '</td></tr>' || chr(10)
|| '<tr><td colspan="2">' || replace(replace(item, '<', '&lt;'), '>', '&gt;') || '</td></tr></table>') AS line FROM lin""")
def render_html(spark: SparkSession, d: str) -> DataFrame:
    return rendering.lines(lines(spark, d), humanize_addresses=True, html=True).withColumn("line", F.md5("line"))


@query(f"""WITH {LIN}, n_ AS (SELECT count(*) AS n FROM lin), x AS (SELECT ord, n, (ord + 1) || ':' || doc_id AS t FROM lin, n_ WHERE n <= 1000 OR ord < 5 OR ord >= n - 5)
SELECT 'head;' || CASE WHEN min(n) <= 1000 THEN string_agg(t, ';' ORDER BY ord) ELSE string_agg(t, ';' ORDER BY ord) FILTER (ord < 5) || chr(10) || chr(10) || '[' || (min(n) - 10) || ' segments not displayed...]' || chr(10) || chr(10) || string_agg(t, ';' ORDER BY ord) FILTER (ord >= n - 5) END || ';foot' AS text FROM x""")
def render_summary(spark: SparkSession, d: str) -> DataFrame:
    text = rendering.to_string(lines(spark, d), "%(__num__)s:%(__str_index__)s", ";", "head;", ";foot")
    return spark.createDataFrame([(text,)], "text string")


@query(f"WITH {LIN} SELECT count(*) > 1000 AS shortened, least(count(*), CASE WHEN count(*) > 1000 THEN 10 ELSE count(*) END) AS shown FROM lin")
def render_html_page(spark: SparkSession, d: str) -> DataFrame:
    page, shortened = rendering.to_html(lines(spark, d))
    return spark.createDataFrame([(shortened, page.count("Segment #"))], "shortened boolean, shown long")


@query(f"SELECT lang AS context, item AS unit, count(*) AS value FROM {_UNNEST} GROUP BY 1, 2")
def stream_word_counts(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream of files, counted to the end."""
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    out = scratch_path(spark, "stream-counts")
    counts = stream_counts(stream, WORD, context_col="lang").where("unit IS NOT NULL")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


