"""Segmentations: annotated (string, start, end) spans as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.functions.patterns import portable
from spanloom.plans.ordinals import prefix_sums, with_ordinals
from spanloom.plans.session import materialize, ship, small_or_plain

NONE = "__none__"
ADDRESS = ("str_index", "start", "end")

#: Rows of each that are handed on at a time.
EACH = 10_000

#: Segments shown in full; of more, the first and last SHOWN are shown.
FULL, SHOWN = 1000, 5


def no_annotations() -> Column:
    return F.expr("cast(map() as map<string,string>)")


class Segmentation:
    """A labelled, ordered set of segments.

    Columns of df: str_index, real_str_index (the string a pointer leads to), start, end
    (half-open, in characters), annotations and content, and ord where it has been needed.
    Without ord the order is that of the address, (str_index, start, end, tie).
    whole says that each segment covers its string, one to a string, and pointers that some
    strings lead to others. recipe remembers (parent, pattern) of a plain tokenization, so that
    counting can stay inside the JVM; ordering makes df with ord where that takes no sort, and
    chains gives the units of each string as arrays. cuts gives a row for each string with all its
    segments, (str_index, real_str_index, annotations, tokens of (start, end, content)), where they
    have its annotations; their order is that of their strings, and the array's. df may be made
    when it is first asked for.
    """

    def __init__(
        self, df: DataFrame | Callable[[], DataFrame], label: str = "segmented_data", whole: bool = False, recipe: tuple[Segmentation, str] | None = None,
        ordering: Callable[[], DataFrame] | None = None, pointers: bool = False, chains: Callable[[], DataFrame] | None = None,
        cuts: Callable[[], DataFrame] | None = None,
    ):
        self._df, self.label, self.whole, self.recipe, self._ordering, self.pointers = df, label, whole, recipe, ordering, pointers
        self._offsets: DataFrame | None = None
        self._chains, self.cuts = chains, cuts
        # (str_index, n) without cutting anything in Python, and the highest str_index, where they are known
        self.counts: Callable[[], DataFrame] | None = None
        self.highest: Callable[[], int | None] = lambda: self.df.agg(F.max("str_index")).first()[0]

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df

    @property
    def disjoint(self) -> bool:
        """Whether no two segments can share a place: whole strings, or plain tokens of disjoint segments."""
        return self.whole or (self.recipe is not None and self.recipe[0].disjoint)

    @property
    def ordered(self) -> DataFrame:
        """df with ord, 0 .. N-1."""
        if "ord" not in self.df.columns:
            if self._ordering is not None:
                self._df = self._ordering()
            else:
                tie = [c for c in ("tie",) if c in self._df.columns]
                self._df = with_ordinals(self._df, "start", "end", *tie)
        return self._df

    def token_offsets(self) -> DataFrame | None:
        """(str_index, n, offset) of plain tokens of whole strings: their number and the first one's ordinal.

        The strings' own text is counted inside the JVM, once; the rows are written.
        """
        if self._offsets is None and self.recipe and self.recipe[0].whole and portable(self.recipe[1]):
            parent, pattern = self.recipe
            counts = parent.df.select("str_index", F.regexp_count("content", F.lit(pattern)).cast("long").alias("n"))
            self._offsets = materialize(prefix_sums(counts, "str_index"), "token-offsets")
        return self._offsets

    @property
    def recipe_pointers(self) -> bool:
        """Whether the strings that the tokens were cut from may be pointers to others."""
        return self.recipe is not None and self.recipe[0].pointers

    def runs(self, cat: str | None = None, numbered: bool = True) -> DataFrame | None:
        """(str_index, real_str_index, n, offset, items[, cat]): each string's tokens as one array, for plain tokens of whole strings.

        cat is their annotation of that key, which is their string's. Without numbered, offset is 0 everywhere.
        """
        if not self.recipe or not self.recipe[0].whole or not portable(self.recipe[1]):
            return None
        parent, pattern = self.recipe
        items = parent.df.select("str_index", "real_str_index", F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("items"), *([parent.item_or_none(cat).alias("cat")] if cat else []))
        if not numbered:
            return items.select("*", F.size("items").cast("long").alias("n"), F.lit(0).cast("long").alias("offset"))
        return items.join(small_or_plain(self.token_offsets().where("n > 0").select("str_index", "n", "offset")), "str_index")

    def chains(self, key: str | None, merge_strings: bool, n: int) -> DataFrame | None:
        """(ord, items): the units of each string, pointers followed, as arrays, where they are known without any order of all units."""
        return self._chains() if self._chains is not None and key is None and not merge_strings and n > 1 else None

    def item(self, key: str | None = None) -> Column:
        """A segment's content, or its annotation of that key, null where it has none."""
        return F.col("annotations")[key] if key else F.col("content")

    def item_or_none(self, key: str | None = None) -> Column:
        return F.coalesce(self.item(key), F.lit(NONE))

    def replace(self, df: DataFrame, label: str | None = None, **kw) -> Segmentation:
        return Segmentation(df, label or self.label, **kw)

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def __getitem__(self, at: int | slice) -> Row | Segmentation:
        """The segment of that ordinal (negative from the end), or a slice as a segmentation."""
        if isinstance(at, slice):
            lo, hi, step = at.indices(self.count())
            if step < 1:
                raise ValueError("a slice's step must be positive")
            return self.replace(self.ordered.where((F.col("ord") >= lo) & (F.col("ord") < hi) & ((F.col("ord") - lo) % step == 0)))
        n = at if at >= 0 else self.count() + at
        rows = self.ordered.where(F.col("ord") == n).take(1)
        if not rows:
            raise IndexError(at)
        return rows[0]

    def __iter__(self) -> Iterator[Row]:
        return self.ordered.orderBy("ord").toLocalIterator()

    def each(self, make: Callable[[Iterator[Row]], Iterator[tuple]], schema: str) -> DataFrame:
        """The rows that make draws from the segments of a task, which it meets where they are; none goes by the driver.

        The segments of a string that were cut from it follow each other; ord tells their place in the whole.
        """
        ship(self.df.sparkSession)
        seg = self.ordered
        row = Row(*seg.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row(*x) for b in batches for x in zip(*(c.to_pylist(maps_as_pydicts="strict") for c in b.columns), strict=True))
            out = make(rows)
            while part := list(islice(out, EACH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

        fields = T._parse_datatype_string(schema).fields
        names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
        return seg.mapInArrow(run, schema)

    def set_segment(self, at: int, start: int, end: int, annotations: dict | None = None) -> Segmentation:
        """A segmentation with the segment of that ordinal moved inside its string's content."""
        here = F.col("ord") == at
        text = F.expr(f"substring(content, {start} - start + 1, {end - start})")
        ann = F.create_map(*(F.lit(x) for kv in (annotations or {}).items() for x in kv)) if annotations else no_annotations()
        df = self.ordered.withColumn("content", F.when(here, text).otherwise(F.col("content")))
        df = df.withColumns({"start": F.when(here, F.lit(start)).otherwise(F.col("start")), "end": F.when(here, F.lit(end)).otherwise(F.col("end")), "annotations": F.when(here, ann).otherwise(F.col("annotations"))})
        return self.replace(df)

    def append(self, other: Segmentation) -> Segmentation:
        """The segments of other after one's own."""
        mine, n = self.ordered, self.count()
        return self.replace(mine.unionByName(other.ordered.withColumn("ord", F.col("ord") + n), allowMissingColumns=True))

    extend = append

    def sorted_by_string(self) -> Segmentation:
        """Runs of segments re-ordered by their string's number, keeping their order inside it."""
        return self.replace(with_ordinals(self.ordered.withColumnRenamed("ord", "tie"), "tie").drop("tie"))

    def string_starts(self) -> DataFrame:
        """(str_index, first ordinal)."""
        return self.ordered.groupBy("str_index").agg(F.min("ord").alias("first_ord"))

    def annotation_keys(self) -> DataFrame:
        """Distinct annotation keys in use, in order."""
        return self.df.select(F.explode(F.map_keys("annotations")).alias("annotation_key")).distinct().orderBy("annotation_key")

    def overlaps(self) -> DataFrame:
        """Segments that begin before an earlier one of their string has ended."""
        w = W.partitionBy("str_index").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
        return self.df.withColumn("reach", F.max("end").over(w)).where("start < reach").drop("reach")

    def is_non_overlapping(self) -> bool:
        return self.overlaps().isEmpty()

    def copy(self, annotations: dict[str, str] | None = None, update: bool = True, label: str | None = None) -> Segmentation:
        """A copy whose annotations are extended (update) or replaced by those given."""
        new = F.create_map(*(F.lit(x) for kv in (annotations or {}).items() for x in kv)) if annotations else no_annotations()
        df = self.df
        if update and annotations:
            df = df.withColumn("annotations", merge_maps(F.col("annotations"), new))
        elif not update:
            df = df.withColumn("annotations", new)
        return Segmentation(df, label or self.label, self.whole)


def merge_maps(first: Column, then: Column) -> Column:
    """The union of two maps; the second one's values win."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(then), k))
    return F.map_concat(kept, then)
