"""Counting units in contexts, in sliding windows and in chains of neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.patterns import portable
from spanloom.operators.contain import contained, contained_sequences
from spanloom.operators.segmentation import NONE, Segmentation
from spanloom.operators.table import CrossTab
from spanloom.plans.session import ship

GLOBAL = "__global__"


def _counted(pairs: DataFrame) -> CrossTab:
    return CrossTab.of(pairs.groupBy("row_id", "col_id").agg(F.count(F.lit(1)).alias("value")))


def items_of(units: Segmentation, key: str | None = None) -> DataFrame:
    """(ord, str_index, real_str_index, item) of all units, in the JVM alone where the text gives them."""
    runs = units.runs() if key is None else None
    if runs is None:
        return units.ordered.select("ord", "str_index", "real_str_index", units.item_or_none(key).alias("item"))
    # outer: for explode alone Spark puts a filter by the array's size below, which cuts the text once more
    each = runs.select("str_index", "real_str_index", "offset", F.posexplode_outer("items").alias("pos", "item"))
    return each.select((F.col("offset") + F.col("pos")).alias("ord"), "str_index", "real_str_index", "item")


def _met(edge: DataFrame, n: int, by: list[str], cols: list[str]) -> DataFrame:
    """The n consecutive units that lie in more than one string, as arrays, from the units near the strings' ends."""
    parts = edge.select(F.explode(F.sequence(F.col("ord") - (n - 1), F.col("ord"))).alias("at"), "str_index", F.struct("ord", *cols).alias("x"), *by)
    met = parts.groupBy("at", *by).agg(F.count(F.lit(1)).alias("k"), F.min("str_index").alias("lo"), F.max("str_index").alias("hi"), F.array_sort(F.collect_list("x")).alias("xs"))
    return met.where((F.col("k") == n) & (F.col("lo") < F.col("hi"))).select(F.col("at").alias("ord"), *(F.col(f"xs.{c}").alias(f"{c}s") for c in cols))


def stretches(units: Segmentation, n: int, key: str | None = None, cross_strings: bool = True, by: str = "str_index", cat: str | None = None) -> DataFrame:
    """(ord, items[, cats]): arrays of consecutive units; every n units that follow each other lie in one of them.

    A string's tokens are one array, without a shuffle; other units are brought together by
    their string, n to an array. Across strings, the last and first n - 1 units of each string
    meet by their ordinals: only those rows are shuffled, and no window spans the corpus.
    Strings that are brought together by another column follow each other in the order of their
    numbers, even without cross_strings; ord then counts from the first of them. cat adds the
    units' annotations of that key.
    """
    cols = ["item"] if cat is None else ["item", "cat"]
    # nothing that stays in its string, or follows it through pointers, needs the corpus's order
    runs = units.runs(cat, cross_strings or by == "str_index") if key is None else None
    if runs is None:
        u = units.ordered.select("ord", "str_index", "real_str_index", units.item_or_none(key).alias("item"), *([units.item_or_none(cat).alias("cat")] if cat is not None else []))
        if n == 1:
            return u.select("ord", *(F.array(c).alias(f"{c}s") for c in cols))
        w = W.partitionBy(by).orderBy("ord")
        inner = u.select("ord", *(F.array(F.col(c), *(F.lead(c, k).over(w) for k in range(1, n))).alias(f"{c}s") for c in cols), F.lead("item", n - 1).over(w).isNotNull().alias("ok")).where("ok").drop("ok")
        if not cross_strings:
            return inner
        edge = u.withColumn("from_end", F.row_number().over(W.partitionBy("str_index").orderBy(F.desc("ord")))).withColumn("from_start", F.row_number().over(W.partitionBy("str_index").orderBy("ord")))
        return inner.unionByName(_met(edge.where((F.col("from_end") < n) | (F.col("from_start") < n)), n, [], cols))
    chained = by == "real_str_index" and not cross_strings
    size = F.col("n").cast("int")
    many = [] if cat is None else [F.array_repeat("cat", size).alias("cats")]
    inner = (runs if chained else runs.where(size >= n)).select(F.col("offset").alias("ord"), "items", *many)
    if n == 1 or not (cross_strings or chained and units.recipe_pointers):
        return inner
    chain = []
    if not cross_strings:
        chain = ["real_str_index"]
        before = W.partitionBy(*chain).orderBy("str_index").rowsBetween(W.unboundedPreceding, -1)
    edge = edges(runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))) if chain else runs, n - 1)
    return inner.unionByName(_met(edge, n, chain, cols))


def edges(runs: DataFrame, n: int) -> DataFrame:
    """The first and last n units of each string's array, with their ordinals and the array's other columns."""
    size = F.col("n").cast("int")
    head = F.least(size, F.lit(n))
    tail = F.greatest(size - n, head)
    near = F.concat(
        F.transform(F.slice("items", 1, head), lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("item"))),
        F.transform(F.slice("items", tail + 1, size - tail), lambda x, i: F.struct((tail + i).cast("long").alias("pos"), x.alias("item"))),
    )
    kept = [c for c in runs.columns if c not in ("items", "n")]
    each = runs.select(*kept, near.alias("near")).select(*kept, F.explode_outer("near").alias("e"))
    return each.select(*(c for c in kept if c != "offset"), (F.col("offset") + F.col("e.pos")).alias("ord"), F.col("e.item").alias("item"))


def sequences(units: Segmentation, n: int, key: str | None = None, cross_strings: bool = True, by: str = "str_index") -> DataFrame:
    """(ord, xs): the n consecutive units from each unit on, as an array, where there are so many."""
    size = F.size("items")
    # the array from each of n places on, side by side: a slice copies the whole array, so there are n of them and not one for each unit
    shifted = [F.slice("items", k + 1, size - (n - 1)).alias(f"x{k}") for k in range(n)]
    each = stretches(units, n, key, cross_strings, by).select("ord", *shifted).select("ord", F.posexplode(F.arrays_zip(*(f"x{k}" for k in range(n)))).alias("pos", "x"))
    return each.select((F.col("ord") + F.col("pos")).alias("ord"), F.array(*(F.col(f"x.x{k}") for k in range(n))).alias("xs"))


#: Units of windows that are laid side by side at a time.
WINDOW_UNITS = 1 << 20


def windowed(arrays: DataFrame, n: int, each: Callable, schema: str, seq_length: int = 1, delimiter: str = "#", ranked: bool = False, pairs: bool = False) -> DataFrame:
    """What each makes of the windows of n units in arrays (of stretches), some windows at a time, in Python workers.

    each(window, codes, names, cats) gets the windows' ordinals, a matrix of the units' (or
    n-grams') codes with a row for each window, the units of the codes, and a like matrix of
    categories' codes or None; it gives columns. Codes hold for one call, and are in the order
    of the units if ranked; fewer windows come at a time if pairs are made of them. A batch's windows are views of its arrays, so nothing is copied by
    window in the JVM and nothing is shuffled.
    """
    ship(arrays.sparkSession)
    has_cats = "cats" in arrays.columns
    m = n - seq_length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            window, at = places(b.column(0), b.column(1), n)
            if not len(at):
                continue
            flat = b.column(1).flatten()
            if seq_length > 1:
                flat = joined(flat, seq_length, delimiter)
            codes, names = encoded(flat, ranked)
            cats = encoded(b.column(2).flatten(), False)[0] if has_cats else None
            step = max(1, WINDOW_UNITS // (m * m if pairs else m))
            for lo in range(0, len(at), step):
                view = at[lo : lo + step, None] + np.arange(m)
                yield from each(window[lo : lo + step], codes[view], names, None if cats is None else cats[view])

    return arrays.select("ord", "items", *(["cats"] if has_cats else [])).mapInArrow(run, schema)


def places(ords: pa.Array, items: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ordinal, place among all items) of the first of each n items that follow each other in a list."""
    sizes = np.diff(items.offsets.to_numpy())
    first = np.cumsum(sizes) - sizes
    k = np.maximum(sizes - n + 1, 0)
    within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return np.repeat(ords.to_numpy(), k) + within, np.repeat(first, k) + within


def joined(flat: pa.Array, n: int, delimiter: str) -> pa.Array:
    """The n-gram from each place on; the last n - 1 have none."""
    size = max(len(flat) - n + 1, 0)
    return pc.binary_join_element_wise(*(flat.slice(k, size) for k in range(n)), delimiter)


def encoded(flat: pa.Array, ranked: bool) -> tuple[np.ndarray, pa.Array]:
    """(codes, values): the array by numbers of its values, which are in order if ranked."""
    d = flat.dictionary_encode()
    codes, names = d.indices.to_numpy(), d.dictionary
    if ranked:
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes, names = rank[codes], names.take(pa.array(order))
    return codes, names


def tallies(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, f): how often each code is in each row of a matrix; by row and code."""
    x = np.sort(codes, axis=1)
    new = np.ones(x.shape, bool)
    new[:, 1:] = x[:, 1:] != x[:, :-1]
    at = np.flatnonzero(new.ravel())
    return at // x.shape[1], x.ravel()[at], np.diff(np.append(at, x.size))


def ngrams(units: Segmentation, n: int, key: str | None = None, delimiter: str = "#", cross_strings: bool = True) -> DataFrame:
    """(ord, gram) of the n-grams of consecutive units, by the ordinal of their first unit."""
    if n == 1:
        return items_of(units, key).select("ord", F.col("item").alias("gram"))
    return sequences(units, n, key, cross_strings).select("ord", F.array_join("xs", delimiter).alias("gram"))


def count_in_context(
    units: Segmentation, contexts: Segmentation | None = None, unit_key: str | None = None, seq_length: int = 1, delimiter: str = "#",
    context_key: str | None = None, merge_contexts: bool = False, digest_contexts: bool = False,
) -> CrossTab:
    """How often each unit type (or n-gram) occurs in each context type.

    With digest_contexts, contexts go by the MD5 of their names, for what needs no names.

    Without contexts, or with merged ones, there is a single context __global__. A unit that
    lies in several contexts counts once in each. N-grams inside contexts are of units whose
    ordinals follow each other.
    """
    if contexts is None:
        if seq_length > 1:
            return _counted(ngrams(units, seq_length, unit_key, delimiter).select(F.lit(GLOBAL).alias("row_id"), F.col("gram").alias("col_id")))
        if (fast := _in_place(units, None, unit_key, True)) is not None:
            return _counted(fast)
        return _counted(units.df.select(F.lit(GLOBAL).alias("row_id"), units.item_or_none(unit_key).alias("col_id")))
    ctx = F.lit(GLOBAL) if merge_contexts else contexts.item_or_none(context_key)
    if digest_contexts and not merge_contexts:
        ctx = F.unhex(F.md5(ctx))
    if seq_length == 1:
        if units.recipe and units.recipe[0] is contexts and contexts.disjoint and (fast := _in_place(units, ctx, unit_key, False)) is not None:
            return _counted(fast)
        return _counted(contained(units, contexts, {"col_id": units.item_or_none(unit_key)}, {"row_id": ctx}))
    inside = contained_sequences(units, contexts, seq_length, units.item_or_none(unit_key), {"row_id": ctx})
    return _counted(inside.select("row_id", F.array_join("items", delimiter).alias("col_id")))


def _in_place(units: Segmentation, ctx: Column | None, unit_key: str | None, anywhere: bool) -> DataFrame | None:
    """(row_id, col_id) of plain tokens straight from their parents' text, inside the JVM, where that is the same."""
    if units.recipe is None or unit_key or not portable(units.recipe[1]):
        return None
    parent, pattern = units.recipe
    tokens = F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))
    return parent.df.select((F.lit(GLOBAL) if anywhere else ctx).alias("row_id"), tokens.alias("col_id"))


def in_windows(units: Segmentation, window_size: int, unit_key: str | None = None, seq_length: int = 1, delimiter: str = "#") -> DataFrame:
    """(window from 0, units): the units or n-grams of every window of consecutive units, in order."""
    if window_size < seq_length:
        raise ValueError("a window must hold an n-gram")
    xs = F.col("xs")
    if seq_length > 1:
        xs = F.transform(F.sequence(F.lit(1), F.lit(window_size - seq_length + 1)), lambda i: F.array_join(F.slice("xs", i, seq_length), delimiter))
    return sequences(units, window_size, unit_key).select(F.col("ord").alias("window"), xs.alias("units"))


def window_counts(units: Segmentation, window_size: int, unit_key: str | None = None, seq_length: int = 1, delimiter: str = "#") -> DataFrame:
    """(window from 0, unit, value): how often each unit occurs in each window.

    A window's units lie side by side, so they are counted there and nothing is shuffled by window.
    """
    if window_size < seq_length:
        raise ValueError("a window must hold an n-gram")

    def each(window, codes, names, _):
        row, code, f = tallies(codes)
        yield pa.RecordBatch.from_arrays([pa.array(window[row]), names.take(pa.array(code)), pa.array(f.astype(np.int64))], names=["window", "unit", "value"])

    return windowed(stretches(units, window_size, unit_key), window_size, each, "window long, unit string, value long", seq_length, delimiter)


def count_in_window(units: Segmentation, window_size: int = 1, unit_key: str | None = None, seq_length: int = 1, delimiter: str = "#") -> CrossTab:
    """How often each unit occurs in each window of consecutive units; windows are named 1, 2, ... and cross strings."""
    w = window_counts(units, window_size, unit_key, seq_length, delimiter)
    return CrossTab.of(w.select((F.col("window") + 1).cast("string").alias("row_id"), F.col("unit").alias("col_id"), "value"))


def count_in_chain(
    units: Segmentation, left_size: int = 1, right_size: int = 0, marker: str = "_", merge_strings: bool = False, unit_key: str | None = None,
    seq_length: int = 1, delimiter: str = "#",
) -> CrossTab:
    """How often each unit occurs between its left and right neighbours.

    The context is the left units, the marker and the right units. Neighbours are of the same
    string, pointers followed, unless merge_strings.
    """
    total = left_size + seq_length + right_size
    if (chains := units.chains(unit_key, merge_strings, total)) is None:
        chains = stretches(units, total, unit_key, merge_strings, "str_index" if merge_strings else "real_str_index")
    ship(chains.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, at = places(b.column(0), b.column(1), total)
            flat, here = b.column(1).flatten(), pa.array(at)
            if not len(at):
                continue

            def part(first: int, n: int) -> pa.Array | str:
                return joined(flat.slice(first), n, delimiter).take(here) if n else ""

            row = pc.binary_join_element_wise(part(0, left_size), pa.scalar(marker), part(left_size + seq_length, right_size), "") if left_size + right_size else pa.array([marker] * len(at))
            yield pa.RecordBatch.from_arrays([row, part(left_size, seq_length)], names=["row_id", "col_id"])

    return _counted(chains.select("ord", "items").mapInArrow(run, "row_id string, col_id string"))


__all__ = ["GLOBAL", "NONE", "count_in_chain", "count_in_context", "count_in_window", "edges", "in_windows", "items_of", "ngrams", "sequences", "stretches", "window_counts", "windowed"]
