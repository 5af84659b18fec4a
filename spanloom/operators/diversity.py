"""Lexical diversity of contexts and windows: variety, perplexity, expected and resampled variety."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.patterns import portable
from spanloom.operators.contain import contained
from spanloom.operators.counting import GLOBAL, count_in_context, stretches, tallies, window_counts, windowed
from spanloom.operators.segmentation import Segmentation
from spanloom.plans.session import ship


def _in_context(units: Segmentation, contexts: Segmentation | None, unit_key, category_key, seq_length, delimiter, context_key, merge, per_category) -> DataFrame:
    """(context, cat, unit, f)."""
    if not per_category:
        t = count_in_context(units, contexts, unit_key, seq_length, delimiter, context_key, merge).df
        return t.select(F.col("row_id").alias("context"), F.lit(None).cast("string").alias("cat"), F.col("col_id").alias("unit"), F.col("value").alias("f"))
    cols = {"cat": units.item_or_none(category_key), "unit": units.item_or_none(unit_key)}
    if contexts is not None and contexts.disjoint and category_key and not unit_key and units.recipe and units.recipe[0] is contexts and portable(units.recipe[1]):
        # plain tokens have their parent's annotations, so they are counted where its text is
        name = F.lit(GLOBAL) if merge else contexts.item_or_none(context_key)
        tokens = F.explode_outer(F.regexp_extract_all("content", F.lit(units.recipe[1]), F.lit(0)))
        rows = contexts.df.select(name.alias("context"), contexts.item_or_none(category_key).alias("cat"), tokens.alias("unit")).where("unit IS NOT NULL")
    elif contexts is None:
        rows = units.df.select(F.lit(GLOBAL).alias("context"), *(e.alias(n) for n, e in cols.items()))
    else:
        rows = contained(units, contexts, cols, {"context": F.lit(GLOBAL) if merge else contexts.item_or_none(context_key)})
    return rows.groupBy("context", "cat", "unit").agg(F.count(F.lit(1)).alias("f"))


def _with_cats(units: Segmentation, window_size: int, unit_key, category_key) -> tuple[DataFrame, bool, bool]:
    """(stretches of units and their categories, whether these are the other way round, whether units are their own categories)."""
    if category_key is not None:
        return stretches(units, window_size, unit_key, cat=category_key), False, False
    # the contents are the categories
    return stretches(units, window_size, None, cat=unit_key), unit_key is not None, unit_key is None


def _in_window(units: Segmentation, window_size: int, unit_key, category_key, seq_length, delimiter, per_category) -> DataFrame:
    """(context, cat, unit, f)."""
    name = (F.col("window") + 1).cast("string").alias("context")
    if not per_category:
        w = window_counts(units, window_size, unit_key, seq_length, delimiter)
        return w.select(name, F.lit(None).cast("string").alias("cat"), "unit", F.col("value").alias("f"))
    n = units.ordered.agg(F.count(F.lit(1)).alias("total"))
    u = units.ordered.select("ord", units.item_or_none(category_key).alias("cat"), units.item_or_none(unit_key).alias("unit")).crossJoin(F.broadcast(n))  # one row
    lo, hi = F.greatest(F.lit(0).cast("long"), F.col("ord") + 1 - window_size), F.least("ord", F.col("total") - window_size)
    rows = u.select(F.explode(F.when(hi >= lo, F.sequence(lo, hi))).alias("window"), "cat", "unit")
    return rows.groupBy(name, "cat", "unit").agg(F.count(F.lit(1)).alias("f"))


def _by_row(row: np.ndarray, f: np.ndarray, n: int, weighting: bool) -> np.ndarray:
    """The number of types of each row, or their perplexity, from their frequencies."""
    if not weighting:
        return np.bincount(row, minlength=n).astype(float)
    total = np.bincount(row, f, n)
    return np.exp(np.log(total) - np.bincount(row, f * np.log(f), n) / total)


def _by_category(codes: np.ndarray, cats: np.ndarray, weighting: bool, category_weighting: bool) -> np.ndarray:
    """The mean of each row's categories' diversities."""
    kinds = int(codes.max()) + 1
    row, pair, f = tallies(cats.astype(np.int64) * kinds + codes)
    # a row's pairs are in order, so those of a category follow each other
    cat = pair // kinds
    new = np.append(True, (row[1:] != row[:-1]) | (cat[1:] != cat[:-1]))
    group = np.cumsum(new) - 1
    of = row[new]
    v = _by_row(group, f, len(of), weighting)
    w = np.bincount(group, f) if category_weighting else np.ones(len(of))
    return np.bincount(of, v * w, len(codes)) / np.bincount(of, w, len(codes))


def _of_windows(units: Segmentation, window_size: int, unit_key, category_key, seq_length, delimiter, weighting, per_category, category_weighting, size: int | None) -> DataFrame:
    """(context, variety), or (context, expected_variety) of size draws: measured where a window's units lie side by side, without a shuffle."""
    if window_size < seq_length:
        raise ValueError("a window must hold an n-gram")
    total = window_size - seq_length + 1
    turned = same = False
    if per_category:
        arrays, turned, same = _with_cats(units, window_size, unit_key, category_key)
    else:
        arrays = stretches(units, window_size, unit_key)
    if size is not None:
        seen = np.array([1 - _none_drawn(total, size, f) for f in range(total + 1)])

    def each(window, codes, _, cats):
        if size is not None:
            if total < size:
                return
            row, _, f = tallies(codes)
            got = np.bincount(row, seen[f], len(codes))
        elif per_category:
            cats = codes if same else cats
            got = _by_category(*((cats, codes) if turned else (codes, cats)), weighting, category_weighting)
        else:
            row, _, f = tallies(codes)
            got = _by_row(row, f, len(codes), weighting)
        yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(got)], names=["window", "measure"])

    t = windowed(arrays, window_size, each, "window long, measure double", seq_length, delimiter)
    return t.select((F.col("window") + 1).cast("string").alias("context"), F.col("measure").alias("variety" if size is None else "expected_variety"))


def _perplexity(f: str = "f") -> Column:
    f = F.col(f)
    return F.exp(F.log(F.sum(f)) - F.sum(f * F.log(f)) / F.sum(f))


def _variety(freq: DataFrame, weighting: bool, per_category: bool, category_weighting: bool) -> DataFrame:
    if not per_category:
        return freq.groupBy("context").agg((_perplexity() if weighting else F.count("unit").cast("double")).alias("variety"))
    cats = freq.groupBy("context", "cat").agg((_perplexity() if weighting else F.count("unit").cast("double")).alias("v"), F.sum("f").alias("w"))
    mean = F.sum(F.col("w") * F.col("v")) / F.sum("w") if category_weighting else F.avg("v")
    return cats.groupBy("context").agg(mean.alias("variety"))


def _absent(total: Column, size: int, f: Column) -> Column:
    """Probability that none of a type's f occurrences is among size draws from total."""
    steps = F.least(f, F.lit(size).cast("long"))
    far = F.greatest(f, F.lit(size).cast("long"))
    one = F.aggregate(F.sequence(F.lit(0).cast("long"), steps - 1), F.lit(1.0), lambda a, i: a * (total - far - i).cast("double") / (total - i).cast("double"))
    return F.when(f > total - size, 0.0).otherwise(one)


def expected_variety(freq: DataFrame, size: int, by: str = "context") -> DataFrame:
    """(by, expected): expected number of types in size draws without replacement; groups with fewer tokens are left out.

    The product behind it is computed once per frequency of a group, not once per type.
    """
    kinds = freq.groupBy(by, "f").agg(F.count(F.lit(1)).alias("m"))
    totals = kinds.groupBy(by).agg(F.sum(F.col("f") * F.col("m")).alias("total")).where(F.col("total") >= size)
    return kinds.join(totals, by).groupBy(by).agg(F.sum(F.col("m") * (1 - _absent(F.col("total"), size, F.col("f")))).alias("expected"))


def _none_drawn(total: int, size: int, f: int) -> float:
    """_absent of a number."""
    i = np.arange(min(f, size))
    return 0.0 if f > total - size else float(np.prod((total - max(f, size) - i) / (total - i)))


def _expected(counts: np.ndarray, size: int) -> float:
    total = int(counts.sum())
    return sum((m * (1 - _none_drawn(total, size, int(f))) for f, m in zip(*np.unique(counts, return_counts=True), strict=True)), 0.0)


def adjusted_size(counts: np.ndarray, size: int, target: float) -> int:
    """The sample size in 2..size whose expected variety per token comes near the target, by bisection."""
    low, high, at = 2, size, size
    rate = _expected(counts, at) / at
    while rate != target and low != high:
        if high - low == 1:
            over = _expected(counts, high) / high - target
            under = target - _expected(counts, low) / low
            return high if over < under else low
        at = round((low + high) / 2)
        rate = _expected(counts, at) / at
        low, high = (low, at) if rate < target else (at if rate > target else low, high)
    return at


def _sample_measure(k: np.ndarray, cats: np.ndarray, n_cats: int, weighting: bool, per_category: bool, category_weighting: bool) -> float:
    """Variety of one sample: k occurrences of each type, whose category is cats."""
    on = k > 0
    k, c = k[on].astype(float), cats[on]
    if not per_category:
        return float(np.exp(np.log(k.sum()) - (k * np.log(k)).sum() / k.sum())) if weighting else float(len(k))
    size = np.bincount(c, k, n_cats)
    seen = size > 0
    v = np.bincount(c, minlength=n_cats).astype(float)
    if weighting:
        s = np.bincount(c, k * np.log(k), n_cats)
        v[seen] = np.exp(np.log(size[seen]) - s[seen] / size[seen])
    return float(np.average(v[seen], weights=size[seen] if category_weighting else None))


def _resampled(freq: DataFrame, size: int, repeats: int, seed: int, weighting: bool, per_category: bool, category_weighting: bool, adjust: bool, show_size: bool) -> DataFrame:
    if repeats < 1:
        raise ValueError("num_subsamples must be positive")
    ship(freq.sparkSession)
    if adjust:
        cats = freq.groupBy("context", "cat").agg(F.sum("f").alias("f"))
        target = expected_variety(cats, size).agg((F.max("expected") / size).alias("target"))
        freq = freq.crossJoin(F.broadcast(target))  # one row
    else:
        freq = freq.withColumn("target", F.lit(None).cast("double"))

    def drawn(context: str, f: np.ndarray, cats: pa.ChunkedArray, target: float | None) -> tuple | None:
        n = size
        if f.sum() < size:
            return None
        d = cats.combine_chunks().dictionary_encode()
        codes, names = d.indices.to_numpy(), d.dictionary
        if adjust:
            n = adjusted_size(np.bincount(codes, f).astype(np.int64), size, float(target))
        rng = np.random.default_rng([seed, zlib.crc32(str(context).encode())])
        got = [_sample_measure(rng.multivariate_hypergeometric(f, n, method="marginals"), codes, len(names), weighting, per_category, category_weighting) for _ in range(repeats)]
        return context, np.mean(got), np.std(got), n, repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cats, fs, target, out = None, [], [], None, []
        for b in batches:
            contexts = b.column(0).dictionary_encode()
            codes = contexts.indices.to_numpy()
            if not len(codes):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, hi in pairwise(cuts):
                name = contexts.dictionary[int(codes[lo])].as_py()
                if fs and name != at:
                    out.append(drawn(at, np.concatenate(fs), pa.chunked_array(cats), target))
                    cats, fs = [], []
                at, target = name, b.column(3)[lo].as_py()
                cats.append(b.column(1).slice(lo, hi - lo))
                fs.append(b.column(2).slice(lo, hi - lo).to_numpy())
        if fs:
            out.append(drawn(at, np.concatenate(fs), pa.chunked_array(cats), target))
        rows = [r for r in out if r]
        if rows:
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["context", "variety_average", "variety_std_deviation", "subsample_size", "variety_count"])

    # a context's frequencies come in the order of their categories and units; the units themselves stay in the JVM
    placed = freq.withColumn("cat", F.coalesce("cat", F.lit(""))).repartition("context").sortWithinPartitions("context", "cat", "unit")
    out = placed.select("context", "cat", "f", "target").mapInArrow(run, "context string, variety_average double, variety_std_deviation double, subsample_size long, variety_count long")
    return out if show_size else out.drop("subsample_size")


def _measure(freq: DataFrame, weighting, per_category, category_weighting, adjust, resample, size, repeats, seed, always_size: bool) -> DataFrame:
    if not resample:
        return _variety(freq, weighting, per_category, category_weighting)
    _draws(size)
    if per_category or weighting:
        adjust = adjust and per_category
        return _resampled(freq, size, repeats or 0, seed, weighting, per_category, category_weighting, adjust, adjust or (always_size and per_category))
    return expected_variety(freq, size).withColumnRenamed("expected", "expected_variety")


def _draws(size: int | None) -> int:
    if not size or size < 1:
        raise ValueError("resampling needs a subsample_size")
    return size


def _checked(per_category: bool, seq_length: int) -> None:
    if per_category and seq_length > 1:
        raise ValueError("diversity per category is measured on single units, not on sequences")


def variety_in_context(
    units: Segmentation, contexts: Segmentation | None = None, unit_key: str | None = None, seq_length: int = 1, delimiter: str = "#", weighting: bool = False,
    per_category: bool = False, category_key: str | None = None, category_weighting: bool = False, adjust: bool = True, context_key: str | None = None,
    merge_contexts: bool = False, resample: bool = False, subsample_size: int | None = None, num_subsamples: int | None = None, seed: int = 42,
) -> DataFrame:
    """Diversity of the units in each context type.

    (context, variety): the number of types, or their perplexity if weighting; per category
    the mean over categories, weighted by their tokens if category_weighting. With resample,
    the exact expected_variety of subsample_size draws; for weighting or categories, mean,
    population deviation and number of num_subsamples seeded samples, whose size is adjusted
    to the context's diversity of categories if adjust. A context's frequencies (not its
    tokens) meet in one task when samples are drawn.
    """
    _checked(per_category, seq_length)
    freq = _in_context(units, contexts, unit_key, category_key, seq_length, delimiter, context_key, merge_contexts, per_category)
    return _measure(freq, weighting, per_category, category_weighting, adjust, resample, subsample_size, num_subsamples, seed, False)


def variety_in_window(
    units: Segmentation, window_size: int = 1, unit_key: str | None = None, seq_length: int = 1, delimiter: str = "#", weighting: bool = False,
    per_category: bool = False, category_key: str | None = None, category_weighting: bool = False, adjust: bool = True,
    resample: bool = False, subsample_size: int | None = None, num_subsamples: int | None = None, seed: int = 42,
) -> DataFrame:
    """variety_in_context for each window of consecutive units, numbered from 1."""
    _checked(per_category, seq_length)
    if not resample or not (per_category or weighting):
        size = _draws(subsample_size) if resample else None
        return _of_windows(units, window_size, unit_key, category_key, seq_length, delimiter, weighting, per_category, category_weighting, size)
    freq = _in_window(units, window_size, unit_key, category_key, seq_length, delimiter, per_category)
    return _measure(freq, weighting, per_category, category_weighting, adjust, resample, subsample_size, num_subsamples, seed, True)
