"""Operators from segmentations to segmentations."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.patterns import compiled, expand, has_refs, portable, substitute
from spanloom.operators.segmentation import ADDRESS, Segmentation, merge_maps, no_annotations
from spanloom.plans.ordinals import blocked, prefix_sums, ranks, with_ordinals
from spanloom.plans.session import materialize, ship, small_or_plain

SEGMENT = ["str_index", "real_str_index", "start", "end", "annotations", "content"]
_SCHEMA = "str_index long, real_str_index long, start int, end int, annotations map<string,string>, content string"


def auto_number(seg: Segmentation, key: str) -> Segmentation:
    """Each segment's place, 1 .. N, as an annotation."""
    number = F.create_map(F.lit(key), (F.col("ord") + 1).cast("string"))
    return seg.replace(seg.ordered.withColumn("annotations", merge_maps(F.col("annotations"), number)), whole=seg.whole)


def merge_duplicates(seg: Segmentation, take_first: bool = False) -> Segmentation:
    """Segments of one address become one; of two annotations of a key the later (or first) stays."""
    df = seg.ordered
    # maps can't be sorted, their entries can
    anns = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.map_entries("annotations").alias("es")))), lambda x: F.map_from_entries(x["es"]))
    merged = F.aggregate(anns, no_annotations(), lambda a, m: merge_maps(m, a) if take_first else merge_maps(a, m))
    one = df.groupBy(*ADDRESS).agg(F.first("real_str_index").alias("real_str_index"), merged.alias("annotations"), F.first("content").alias("content"))
    return seg.replace(one.select(SEGMENT))


def _finish(seg: Segmentation, merge: bool = False, take_first: bool = False, number: str | None = None) -> Segmentation:
    if merge:
        seg = merge_duplicates(seg, take_first)
    return auto_number(seg, number) if number else seg


def bypass(seg: Segmentation, label: str = "bypassed_data") -> Segmentation:
    """A copy under another label."""
    return Segmentation(seg.df, label, seg.whole, seg.recipe)


def concatenate(
    segs: Sequence[Segmentation], label: str = "segmented_data", copy_annotations: bool = True, import_labels_as: str | None = "component_label",
    sort: bool = False, auto_number_as: str | None = None, merge: bool = False,
) -> Segmentation:
    """All segments, by string and address; at one address those of the earlier input come first.

    Strings keep the order in which the inputs first show them, or ascend if sort.
    """
    if 0 < len(segs) <= MERGED and all(s.cuts is not None for s in segs):
        return _finish(_concatenated(segs, label, copy_annotations, import_labels_as, sort, merge), number=auto_number_as)
    parts: DataFrame | None = None
    for k, s in enumerate(segs):
        ann = F.col("annotations") if copy_annotations else no_annotations()
        if import_labels_as:
            ann = merge_maps(ann, F.create_map(F.lit(import_labels_as), F.lit(s.label)))
        src = s.ordered if not sort or "ord" in s.df.columns else s.df.withColumn("ord", F.lit(0).cast("long"))
        part = src.select(*SEGMENT[:4], ann.alias("annotations"), "content", F.lit(k).alias("input_no"), F.col("ord").alias("input_ord"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("nothing to concatenate")
    tie = F.struct("input_no", "input_ord")
    if sort:
        return _finish(Segmentation(parts.withColumn("tie", tie).drop("input_no", "input_ord"), label), merge, False, auto_number_as)
    # strings by the first input that shows them, and there by their first segment
    seen = parts.groupBy("str_index").agg(F.min(tie).alias("seen")).select("str_index", "seen.*")
    numbered = ranks(seen, "input_no", "input_ord", name="str_rank").select("str_index", "str_rank")
    placed = with_ordinals(parts.join(small_or_plain(materialize(numbered, "string-ranks")), "str_index"), "start", "end", "input_no", "input_ord", key="str_rank").drop("str_rank", "input_no", "input_ord")
    return _finish(Segmentation(placed, label), merge, False, auto_number_as)


#: Inputs, or patterns, whose segments are merged inside their string; each set of them has its own annotations there.
MERGED = 4


def _by_set(anns: Sequence[Column], take_first: bool = False) -> list[Column]:
    """The merged annotations of each set of inputs; set m has those whose bits are in m + 1."""
    out = []
    for m in range(1, 1 << len(anns)):
        one = None
        for a in (a for k, a in enumerate(anns) if m >> k & 1):
            one = a if one is None else (merge_maps(a, one) if take_first else merge_maps(one, a))
        out.append(one)
    return out


def _concatenated(segs: Sequence[Segmentation], label: str, copy_annotations: bool, import_labels_as: str | None, sort: bool, merge: bool) -> Segmentation:
    """Concatenation where each input has a row per string: the rows of a string meet, and its segments are sorted inside them.

    A string's annotations are joined with it once and not with each of its segments, and places
    follow from the counts of the strings before.
    """
    ship(segs[0].df.sparkSession)
    rows: DataFrame | None = None
    for k, s in enumerate(segs):
        ann = F.col("annotations") if copy_annotations else no_annotations()
        if import_labels_as:
            ann = merge_maps(ann, F.create_map(F.lit(import_labels_as), F.lit(s.label)))
        one = s.cuts().where(F.size("tokens") > 0).select("str_index", "real_str_index", F.lit(k).alias("k"), ann.alias("annotations"), "tokens")
        rows = one if rows is None else rows.unionByName(one)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(3)
            inner = parts.flatten()
            tokens = inner.field("tokens").flatten()
            sizes = np.diff(inner.field("tokens").offsets.to_numpy())
            no = np.repeat(inner.field("k").to_numpy(), sizes).astype(np.int64)
            row = np.repeat(np.repeat(np.arange(len(b)), np.diff(parts.offsets.to_numpy())), sizes)
            start, end = (tokens.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
            order = np.lexsort((end << 8 | no, row << 32 | start))
            bits = 1 << no[order]
            if merge:
                r, p, q = row[order], start[order], end[order]
                first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))[: len(order)])
                bits, order = np.bitwise_or.reduceat(bits, first), order[first]
            n = np.bincount(row[order], minlength=len(b))
            cols = [tokens.field(c).take(pa.array(order)) for c in ("start", "end", "content")]
            made = pa.StructArray.from_arrays([*cols, pa.array(bits.astype(np.int32))], names=["start", "end", "content", "inputs"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), made)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], names=["str_index", "real_str_index", "anns", "tokens"])

    def strings() -> DataFrame:
        """A row per string with its segments in order."""
        own = [F.max(F.when(F.col("k") == k, F.col("entries"))) for k in range(len(segs))]
        met = rows.withColumn("entries", F.map_entries("annotations")).groupBy("str_index").agg(
            F.first("real_str_index").alias("real_str_index"), F.array(*own).alias("anns"), F.collect_list(F.struct("k", "tokens")).alias("parts")
        )
        entry = "array<struct<key:string,value:string>>"
        return met.mapInArrow(put_together, f"str_index long, real_str_index long, anns array<{entry}>, tokens array<struct<start:int,end:int,content:string,inputs:int>>")

    def segments(d: DataFrame, *more: Column) -> DataFrame:
        maps = [F.map_from_entries(F.coalesce(F.col("anns")[k], F.array().cast("array<struct<key:string,value:string>>"))) for k in range(len(segs))]
        each = d.withColumn("own", F.array(*maps)).withColumn("anns", F.array(*_by_set([F.col("own")[k] for k in range(len(segs))]) if merge else [F.col("own")[k] for k in range(len(segs))]))
        each = each.select("str_index", "real_str_index", "anns", *more, F.posexplode_outer("tokens").alias("pos", "t"))
        which = F.col("t.inputs") - 1 if merge else F.expr("bit_length(bin(t.inputs)) div 8 - 1").cast("int")
        own = F.get("anns", which).alias("annotations")
        return each.select("str_index", "real_str_index", F.col("t.start").alias("start"), F.col("t.end").alias("end"), own, F.col("t.content").alias("content"), *((c + F.col("pos")).alias("ord") for c in more))

    def tallied() -> DataFrame:
        """(str_index, n, k): how many segments a string has, and the first input that shows it; by counts inside the JVM where each input has them."""
        if merge:
            return strings().select("str_index", F.size("tokens").cast("long").alias("n"), F.lit(0).alias("k"))
        known = rows.select("str_index", F.size("tokens").cast("long").alias("n"), "k")
        if all(s.counts is not None for s in segs):
            each = [s.counts().where("n > 0").select("str_index", "n", F.lit(k).alias("k")) for k, s in enumerate(segs)]
            known = reduce(DataFrame.unionByName, each)
        return known.groupBy("str_index").agg(F.sum("n").alias("n"), F.min("k").alias("k"))

    def ordering() -> DataFrame:
        counts = tallied()
        # strings by the first input that shows them, whose order is theirs
        key = F.struct(F.lit(0).alias("k"), "str_index") if sort or merge else F.struct("k", "str_index")
        counts = prefix_sums(counts.select(key.alias("key"), "n"), "key").select(F.col("key.str_index").alias("o_str"), "offset")
        offsets = small_or_plain(materialize(counts, "string-offsets"))
        return segments(strings().join(offsets, F.col("str_index") == F.col("o_str")), F.col("offset"))

    if merge:
        return Segmentation(lambda: segments(strings()), label, ordering=ordering)
    out = Segmentation((lambda: segments(strings())) if sort else ordering, label, ordering=ordering)
    out.highest = lambda: tallied().agg(F.max("str_index")).first()[0]
    return out


#: Characters that are cut between two results of a Python worker.
SLICE_CHARS = 1_000_000


def text_slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges with about limit bytes of text each, one row at least."""
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(texts).cast(pa.int64()), 0)).to_numpy(zero_copy_only=False)
    at, n = 0, len(texts)
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(ends.searchsorted(done + limit, side="right")))
        yield at, min(to, n)
        at = to


def tokenize(
    seg: Segmentation, regexes: Sequence[tuple], label: str = "segmented_data", import_annotations: bool = True, merge: bool = False, auto_number_as: str | None = None,
) -> Segmentation:
    """Segments of what matches (mode tokenize) or lies between matches (mode split).

    regexes holds (pattern, mode) or (pattern, mode, {key: value}); in mode tokenize key and
    value may refer to groups as &n. Patterns are applied independently and the results
    sorted by address, those of earlier patterns first. No shuffle: each segment is cut where
    it is read.
    """
    ship(seg.df.sparkSession)
    plan = []
    for spec in regexes:
        pattern, mode, *ann = spec
        if mode not in ("tokenize", "split"):
            raise ValueError(f"unknown tokenization mode {mode!r}")
        pairs = list((ann[0] or {}).items()) if ann else []
        plan.append((compiled(pattern), mode == "split", pairs, any(has_refs(k) or has_refs(v) for k, v in pairs)))
    annotated = any(p[2] for p in plan)

    single = len(plan) == 1
    # segments of one address lie in one string: they are merged where it is cut
    inside = merge and seg.whole and len(plan) <= MERGED and not any(p[3] for p in plan)
    if inside:
        return _finish(Segmentation(_merged_in_place(seg, plan, import_annotations), label), number=auto_number_as)
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("content", pa.string())] + ([] if single else [("tie", pa.int32())]) + ([("added", pa.map_(pa.string(), pa.string()))] if annotated else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(4)):
                b = batch.slice(lo, hi - lo)
                texts, offsets = b.column(4).to_pylist(), b.column(3).to_pylist()
                starts, ends, content, ties, anns, sizes = [], [], [], [], [], [0]
                for base, text in zip(offsets, texts, strict=True):
                    for k, (rx, split, pairs, refs) in enumerate(plan):
                        before = len(starts)
                        if split:
                            gaps = [0, *(x for m in rx.finditer(text) for x in m.span()), len(text)]
                            spans = [(p, q) for p, q in zip(gaps[::2], gaps[1::2], strict=True) if q > p]
                        elif refs:
                            found = list(rx.finditer(text))
                            spans = [m.span() for m in found]
                            anns += [[(expand(x, m), expand(v, m)) for x, v in pairs] for m in found]
                        else:
                            spans = [m.span() for m in rx.finditer(text)]
                        starts += [base + p for p, _ in spans]
                        ends += [base + q for _, q in spans]
                        content += [text[p:q] for p, q in spans]
                        n = len(starts) - before
                        if annotated and (split or not refs):
                            anns += [pairs] * n
                        if not single:
                            ties += [k] * n
                    sizes.append(len(starts))
                cols = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(content, pa.string())]
                if not single:
                    cols.append(pa.array(ties, pa.int32()))
                if annotated:
                    cols.append(pa.array(anns, kind.field("added").type))
                tokens = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(kind)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), tokens, b.column(5)], names=["str_index", "real_str_index", "annotations", "tokens", "place"])

    fields = "start int, end int, content string" + ("" if single else ", tie int") + (", added map<string,string>" if annotated else "")

    def cut(parent: DataFrame, place: Column) -> DataFrame:
        """A row per parent segment with its tokens; they are exploded in the JVM, which copies only what is used."""
        ann = F.col("annotations") if import_annotations else no_annotations()
        src = parent.select("str_index", "real_str_index", ann.alias("annotations"), "start", "content", place.cast("long").alias("place"))
        typed = fields.replace(" int", ": int").replace(" string", ": string").replace(" map", ": map")
        return src.mapInArrow(run, f"str_index long, real_str_index long, annotations map<string,string>, tokens array<struct<{typed}>>, place long")

    def columns(ord_: Column | None = None) -> list[Column]:
        ann = merge_maps(F.col("annotations"), F.coalesce("t.added", no_annotations())) if annotated else F.col("annotations")
        more = [] if single else [F.col("t.tie").alias("tie")]
        return [F.col("str_index"), F.col("real_str_index"), F.col("t.start").alias("start"), F.col("t.end").alias("end"), ann.alias("annotations"), F.col("t.content").alias("content"), *more] + ([ord_.alias("ord")] if ord_ is not None else [])

    df = cut(seg.df, F.lit(0)).select("*", F.explode("tokens").alias("t")).select(columns())
    one = single and not plan[0][1] and not annotated and isinstance(regexes[0][0], str)
    out = Segmentation(df, label, recipe=(seg, regexes[0][0]) if one and import_annotations else None)
    if single and seg.whole and not annotated:
        out.cuts = lambda: cut(seg.df, F.lit(0)).select("str_index", "real_str_index", "annotations", "tokens")
        if out.recipe and portable(out.recipe[1]):
            out.counts = lambda: out.token_offsets().select("str_index", "n")
    if single and seg.disjoint:
        # disjoint segments in order, and one pattern: a token's place follows from the counts before its segment

        def ordering() -> DataFrame:
            place = "str_index" if seg.whole else "ord"
            parent = seg.df if seg.whole else seg.ordered
            offsets = out.token_offsets() if seg.whole else None
            if offsets is None:
                counted = cut(parent, F.col(place)).select("place", F.size("tokens").cast("long").alias("n"))
                offsets = materialize(prefix_sums(counted, "place"), "token-offsets")
            offsets = small_or_plain(offsets.select(F.col(offsets.columns[0]).alias("o_place"), "offset"))
            rows = cut(parent, F.col(place)).join(offsets, F.col("place") == F.col("o_place"))
            return rows.select("*", F.posexplode("tokens").alias("pos", "t")).select(columns(F.col("offset") + F.col("pos")))

        out._ordering = ordering
    return _finish(out, merge, False, auto_number_as)


def _merged_in_place(seg: Segmentation, plan: list[tuple], import_annotations: bool) -> DataFrame:
    """The matches of all patterns in whole strings, those of one address as one; the annotations of later patterns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(3)):
                b = batch.slice(lo, hi - lo)
                starts, ends, content, sets, sizes = [], [], [], [], [0]
                for base, text in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True):
                    found: dict[tuple[int, int], int] = {}
                    for k, (rx, split, *_) in enumerate(plan):
                        if split:
                            gaps = [0, *(x for m in rx.finditer(text) for x in m.span()), len(text)]
                            spans = [(p, q) for p, q in zip(gaps[::2], gaps[1::2], strict=True) if q > p]
                        else:
                            spans = [m.span() for m in rx.finditer(text)]
                        if not k:
                            found = dict.fromkeys(spans, 1)
                            continue
                        for x in spans:
                            found[x] = found.get(x, 0) | 1 << k
                    spans = sorted(found)
                    starts += [base + p for p, _ in spans]
                    ends += [base + q for _, q in spans]
                    content += [text[p:q] for p, q in spans]
                    sets += [found[x] for x in spans]
                    sizes.append(len(starts))
                made = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(content, pa.string()), pa.array(sets, pa.int32())], names=["start", "end", "content", "patterns"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), made)], names=["str_index", "real_str_index", "annotations", "tokens"])

    ann = F.col("annotations") if import_annotations else no_annotations()
    src = seg.df.select("str_index", "real_str_index", ann.alias("annotations"), "content", "start")
    rows = src.mapInArrow(run, "str_index long, real_str_index long, annotations map<string,string>, tokens array<struct<start:int,end:int,content:string,patterns:int>>")
    own = [F.create_map(*(F.lit(x) for kv in dict(pairs).items() for x in kv)) if pairs else no_annotations() for _, _, pairs, _ in plan]
    anns = _by_set([merge_maps(F.col("annotations"), a) if import_annotations else a for a in own])
    each = rows.select("str_index", "real_str_index", F.array(*anns).alias("anns"), F.explode("tokens").alias("t"))
    return each.select("str_index", "real_str_index", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.get("anns", F.col("t.patterns") - 1).alias("annotations"), F.col("t.content").alias("content"))


def _pair(seg: Segmentation, keep: Column, label: str, copy_annotations: bool, number: str | None, df: DataFrame | None = None) -> tuple[Segmentation, Segmentation]:
    """(kept, rest) by a condition that is never null."""
    src = seg.df if df is None else df
    if not copy_annotations:
        src = src.withColumn("annotations", no_annotations())
    src_out = [c for c in src.columns if c in SEGMENT or c in ("ord", "tie")]
    kept = src.where(keep).select(src_out)
    rest = src.where(~keep).select(src_out)
    if "ord" in src_out:
        # ordinals are those of the new segmentations
        kept, rest = (x.withColumnRenamed("ord", "tie") if "tie" not in src_out else x.drop("ord") for x in (kept, rest))
    return _finish(Segmentation(kept, label), number=number), _finish(Segmentation(rest, f"NEG_{label}"), number=number)


def _mode(mode: str, *known: str) -> str:
    if mode not in known:
        raise ValueError(f"mode must be one of {', '.join(known)}")
    return mode


def select(
    seg: Segmentation, pattern: str, mode: str = "include", annotation_key: str | None = None, label: str = "selected_data",
    copy_annotations: bool = True, auto_number_as: str | None = None,
) -> tuple[Segmentation, Segmentation]:
    """(segments in whose content or annotation the pattern is found, the others); or the reverse for exclude.

    The pattern is a Java one, so that the filter stays in the JVM. A missing key is no match.
    """
    found = F.coalesce(seg.item(annotation_key).rlike(pattern), F.lit(False))
    keep = found if _mode(mode, "include", "exclude") == "include" else ~found
    kept, rest = _pair(seg, keep, label, copy_annotations, auto_number_as)
    if seg.cuts is not None and annotation_key is None and not auto_number_as:
        ann = F.col("annotations") if copy_annotations else no_annotations()
        with_it = F.filter("tokens", lambda t: F.coalesce(t["content"].rlike(pattern), F.lit(False)))
        without = F.filter("tokens", lambda t: ~F.coalesce(t["content"].rlike(pattern), F.lit(False)))
        for part, tokens in zip((kept, rest), (with_it, without) if mode == "include" else (without, with_it), strict=True):
            part.cuts = lambda tokens=tokens: seg.cuts().select("str_index", "real_str_index", ann.alias("annotations"), tokens.alias("tokens"))
        if seg.counts is not None and seg.recipe:
            items = F.regexp_extract_all("content", F.lit(seg.recipe[1]), F.lit(0))
            found = F.filter(items, lambda x: x.rlike(pattern))
            here, there = F.size(found), F.size(items) - F.size(found)
            for part, n in zip((kept, rest), (here, there) if mode == "include" else (there, here), strict=True):
                part.counts = lambda n=n: seg.recipe[0].df.select("str_index", n.cast("long").alias("n"))
    return kept, rest


def threshold(
    seg: Segmentation, min_count: int | None = None, max_count: int | None = None, annotation_key: str | None = None, label: str = "selected_data",
    copy_annotations: bool = True, auto_number_as: str | None = None,
) -> tuple[Segmentation, Segmentation]:
    """(segments whose item occurs min_count to max_count times, the others); a missing key counts 0 times."""
    item = seg.item(annotation_key)

    def within(freq: Column) -> Column:
        ok = F.lit(True)
        if min_count is not None:
            ok = ok & (freq >= min_count)
        return ok & (freq <= max_count) if max_count is not None else ok

    # partial aggregation takes the load off frequent types; plain tokens are counted in the JVM
    plain = count_types(seg) if annotation_key is None else None
    freq = plain if plain is not None else seg.df.groupBy(item.alias("f_item")).agg(F.count(F.lit(1)).alias("freq")).where("f_item IS NOT NULL")
    kept = materialize(freq.where(within(F.col("freq"))).select("f_item"), "kept-types")
    found = F.col("f_item").isNotNull()
    keep = F.when(item.isNull(), within(F.lit(0))).otherwise(found)
    return _pair(seg, keep, label, copy_annotations, auto_number_as, seg.df.join(small_or_plain(kept), item == F.col("f_item"), "left"))


def count_types(seg: Segmentation) -> DataFrame | None:
    """(f_item, freq) of plain tokens straight from their parents' text, where Java surely finds the same ones."""
    if seg.recipe is None or not portable(seg.recipe[1]):
        return None
    parent, pattern = seg.recipe
    return parent.df.select(F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("f_item")).groupBy("f_item").agg(F.count(F.lit(1)).alias("freq"))


def sample(
    seg: Segmentation, sample_size: int, mode: str = "random", label: str = "sampled_data", copy_annotations: bool = True,
    auto_number_as: str | None = None, seed: int = 42,
) -> tuple[Segmentation, Segmentation]:
    """(a sample, the others): exactly sample_size segments at random, or every k-th one.

    Random order is that of a seeded hash of the ordinal, so it doesn't depend on partitions, and
    the sample is what lies below the sample_size-th hash: a filter, no join and no sort;
    systematic sampling takes k = the total over sample_size, rounded half to even, at least 1.
    """
    _mode(mode, "random", "systematic")
    df, n = seg.ordered, seg.count()
    if mode == "systematic":
        step = max(1, round(n / max(1, sample_size)))
        return _pair(seg, F.col("ord") % step == 0, label, copy_annotations, auto_number_as, df)
    if sample_size >= n or sample_size < 1:
        return _pair(seg, F.lit(sample_size >= n and n > 0), label, copy_annotations, auto_number_as, df)
    hashed = F.xxhash64("ord", F.lit(seed))
    cut, at = _nth_hash(seg.df.sparkSession.range(n).select(F.col("id").alias("ord")).select("ord", hashed.alias("h")), sample_size)
    return _pair(seg, (hashed < cut) | ((hashed == cut) & (F.col("ord") <= at)), label, copy_annotations, auto_number_as, df)


def _nth_hash(hashes: DataFrame, n: int) -> tuple[int, int]:
    """(h, ord) of the n-th row by (h, ord), n from 1: found by two counts of 2**16 ranges each, then in what is left of one."""
    rows = hashes
    for shift in (48, 32):
        bucket = F.shiftright("h", shift)
        counts = sorted((r[0], r[1]) for r in rows.groupBy(bucket.alias("b")).count().collect())
        for b, k in counts:
            if n <= k:
                break
            n -= k
        rows = rows.where(bucket == b)
    last = rows.orderBy("h", "ord").limit(n).collect()[-1]
    return last["h"], last["ord"]


def intersect(
    source: Segmentation, filtering: Segmentation, source_key: str | None = None, filtering_key: str | None = None, mode: str = "include",
    label: str = "selected_data", copy_annotations: bool = True, auto_number_as: str | None = None,
) -> tuple[Segmentation, Segmentation]:
    """(source segments whose item is one of the filtering ones, the others); or the reverse for exclude."""
    items = filtering.df.select(filtering.item(filtering_key).alias("f_item")).where("f_item IS NOT NULL").distinct().withColumn("in_filter", F.lit(True))
    items = small_or_plain(materialize(items, "filter-items"))
    marked = source.df.join(items, source.item(source_key) == F.col("f_item"), "left").withColumn("in_filter", F.coalesce("in_filter", F.lit(False)))
    keep = F.col("in_filter") if _mode(mode, "include", "exclude") == "include" else ~F.col("in_filter")
    return _pair(source, keep, label, copy_annotations, auto_number_as, marked)


def parse_tag(tag: str) -> dict | None:
    """Parts of one markup tag: element, attributes, opening, empty; None for what names no element."""
    inner = tag[1:-1]
    closing = inner.startswith("/")
    empty = inner.endswith("/") and not closing
    inner = inner.strip("/") if closing else (inner[:-1] if empty else inner)
    m = _NAME.match(inner)
    if not m:
        return None
    attributes = {a: (v1 or v2 or "") for a, v1, v2 in _ATTRIBUTE.findall(inner[m.end() :])}
    return {"element": m.group(0), "opening": not closing, "empty": empty, "attributes": {} if closing else attributes}


_NAME = compiled(r"[^\s/!?0-9<>\"'=][^\s/<>\"'=]*")
_ATTRIBUTE = compiled(r"""([^\s"'=/<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_TAG = compiled(r"<[^>]+>")


def _depths(seg: Segmentation, element: str) -> DataFrame:
    """(str_index, net, low): opened minus closed tags of the element in a string, and the least sum on the way."""
    name = "".join("\\" + c if c in "\\.^$|?*+()[]{}" else c for c in element)
    tags = F.regexp_extract_all("content", F.lit(rf"<(/?{name}(?:\s[^>]*)?)>"), F.lit(1))
    step = F.transform(tags, lambda t: F.when(t.startswith("/"), -1).when(t.endswith("/"), 0).otherwise(1))
    run = F.aggregate(step, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + s).alias("at"), F.least(a["low"], a["at"] + s).alias("low")))
    per = seg.ordered.select("str_index", "ord", run.alias("r"))
    return per.select("str_index", "ord", F.col("r.at").alias("net"), F.col("r.low").alias("low"))


def import_xml(
    seg: Segmentation, element: str, conditions: dict[str, str] | None = None, import_element_as: str | None = None, label: str = "xml_data",
    import_annotations: bool = True, merge: bool = False, auto_number_as: str | None = None, remove_markup: bool = False, preserve_leaves: bool = False,
) -> Segmentation:
    """The bodies of an XML element, one segment per string they touch, with the attributes as annotations.

    An element may open in one segment and close in a later one. Segments in which the
    element is balanced are scanned on their own, in parallel; only runs of segments between
    which it stays open are brought together. Raises ValueError for an unmatched tag.
    conditions maps attributes to patterns that must be found in their values. With
    remove_markup, bodies are cut at every tag. Empty segments are left out.
    """
    spark = seg.df.sparkSession
    ship(spark)
    element = element.replace("<", "").replace(">", "")
    wanted = {k: compiled(v) for k, v in (conditions or {}).items()}
    rows = seg.ordered.select("ord", *SEGMENT)
    odd = _depths(seg, element).where("net <> 0 OR low < 0").select("ord", "net", "low")
    odd = materialize(odd, "open-elements")
    if odd.isEmpty():
        grouped = rows.withColumn("run", F.col("ord"))
    else:
        run = odd.join(prefix_sums(odd, "ord", "net", "before").select("ord", "before"), "ord")
        if not run.where("before + low < 0").isEmpty():
            raise ValueError(f"orphan closing tag of {element}")
        if odd.agg(F.sum("net")).first()[0] != 0:
            raise ValueError(f"missing closing tag of {element}")
        # a run begins where nothing was open and ends where nothing is open any more
        placed = blocked(run.select("ord", F.when(F.col("before") == 0, F.col("ord")).alias("first")), "ord")
        earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        carried = placed.groupBy("part").agg(F.max("first").alias("last")).select("part", F.max("last").over(earlier).alias("carried"))  # a row per partition
        own = F.max("first").over(W.partitionBy("part").orderBy("ord"))
        begin = placed.join(F.broadcast(carried), "part").select("ord", F.coalesce(own, "carried").alias("run_first"))
        spans = begin.groupBy("run_first").agg(F.max("ord").alias("last"))
        members = spans.select("run_first", F.explode(F.sequence("run_first", "last")).alias("m_ord"))
        members = small_or_plain(materialize(members, "open-runs"))
        grouped = rows.join(members, F.col("ord") == F.col("m_ord"), "left").withColumn("run", F.coalesce("run_first", "ord")).drop("run_first", "m_ord")
        grouped = grouped.repartition("run").sortWithinPartitions("run", "ord")

    def scan(segments: list[tuple]) -> Iterator[tuple]:
        stack: list[dict] = []  # open elements: attributes and pieces [segment, start, end]
        emitted = 0
        for n, (_, si, rsi, start, end, ann, text) in enumerate(segments):
            own = dict(ann) if import_annotations and ann else {}
            if import_element_as:
                own[import_element_as] = element
            for o in stack:
                o["pieces"].append([n, start, None, own])
            for m in _TAG.finditer(text):
                tag = parse_tag(m.group(0))
                a, b = start + m.start(), start + m.end()
                mine = tag is not None and tag["element"] == element and not tag["empty"]
                if remove_markup:
                    for o in stack:
                        if o["pieces"][-1][2] is None:
                            o["pieces"][-1][2] = a
                if mine and tag["opening"]:
                    stack.append({"attributes": tag["attributes"], "pieces": []})
                    if not remove_markup:
                        stack[-1]["pieces"].append([n, b, None, own])
                elif mine:
                    if not stack:
                        raise ValueError(f"orphan closing tag of {element}")
                    o = stack.pop()
                    if o["pieces"] and o["pieces"][-1][2] is None:
                        o["pieces"][-1][2] = a
                    for k, p, q, base in o["pieces"]:
                        _, psi, prsi, pstart, pend, _, ptext = segments[k]
                        q = pend if q is None else q
                        full = base | o["attributes"]
                        if p < q and all(c in full and rx.search(full[c]) for c, rx in wanted.items()):
                            yield psi, prsi, p, q, list(full.items()), ptext[p - pstart : q - pstart], emitted
                            emitted += 1
                if remove_markup:
                    for o in stack:
                        o["pieces"].append([n, b, None, own])
        if stack:
            raise ValueError(f"missing closing tag of {element}")

    def run_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[*SEGMENT, "tie"])

        for b in batches:
            found = []
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*cols, strict=True):
                if row[-1] != at:
                    found += scan(held)
                    held, at = [], row[-1]
                held.append(row[:-1])
            yield out(found)
        yield out(list(scan(held)))

    df = grouped.mapInArrow(run_groups, _SCHEMA + ", tie long")
    return _finish(Segmentation(df, label), merge, preserve_leaves, auto_number_as)


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def recode(
    seg: Segmentation, substitutions: Sequence[tuple[str, str]] | None = None, case: str | None = None, remove_accents: bool = False,
    label: str = "recoded_data", copy_annotations: bool = True, check_overlap: bool = True,
) -> tuple[Segmentation, DataFrame]:
    """(recoded segments, a one-row DataFrame with the number of replacements, n_replacements).

    The case is changed, then accents removed, then the substitutions made one after the
    other; &n in a replacement is the pattern's group n. A changed segment becomes a new
    string of its own; an unchanged one keeps its address, or gets a pointer to its string
    if the segment before it was changed and the last unchanged one was of the same string.
    Raises ValueError for overlapping segments unless check_overlap is off.
    """
    if case not in (None, "lower", "upper"):
        raise ValueError("case must be lower, upper or None")
    spark = seg.df.sparkSession
    ship(spark)
    if check_overlap and not seg.disjoint and not seg.is_non_overlapping():
        raise ValueError("segments overlap")
    rules = [(compiled(p), r) for p, r in (substitutions or ())]

    def change(text: str) -> tuple[str, int]:
        n = 0
        if case:
            text = text.lower() if case == "lower" else text.upper()
        if remove_accents:
            text = strip_accents(text)
        for rx, repl in rules:
            text, k = substitute(rx, repl, text)
            n += k
        return text, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([change(t)[0] for t in b.column(6).to_pylist()], pa.string())], names=[*b.schema.names, "text"])

    in_jvm = not rules and not remove_accents
    lowered = F.lower("content") if case == "lower" else (F.upper("content") if case else F.col("content"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(change(t)[1] for t in b.column(0).to_pylist())], pa.int64())], names=["n_sub"])

    found = spark.range(1).select(F.lit(0).cast("long").alias("n_sub")) if in_jvm else seg.df.select("content").mapInArrow(counted, "n_sub long")
    total = found.agg(F.coalesce(F.sum("n_sub"), F.lit(0)).cast("long").alias("n_replacements"))

    def recoded() -> DataFrame:
        src = seg.ordered.select("ord", *SEGMENT)
        if in_jvm:
            # cheap to do again: nothing is written
            return _readdressed(src.withColumn("text", lowered), (seg.highest() or 0) + 1, copy_annotations)
        done = materialize(src.mapInArrow(run, "ord long, " + _SCHEMA + ", text string"), "recoded")
        return _readdressed(done, (done.agg(F.max("str_index")).first()[0] or 0) + 1, copy_annotations)

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column(0).flatten().dictionary_encode()
            same = np.array([change(t)[0] == t for t in d.dictionary.to_pylist()], bool)
            keep = same[d.indices.to_numpy()]
            sizes = np.diff(b.column(0).offsets.to_numpy())
            n = np.bincount(np.repeat(np.arange(len(b)), sizes)[keep], minlength=len(b))
            items = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), d.dictionary.take(d.indices.filter(pa.array(keep))))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int64)), items], names=["ord", "items"])

    def chains() -> DataFrame:
        """A changed segment is a string of its own, so those of a string follow each other that are as they were."""
        parent, pattern = seg.recipe
        return parent.df.select(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("items")).mapInArrow(unchanged, "ord long, items array<string>")

    plain = seg.recipe is not None and seg.recipe[0].whole and not seg.recipe_pointers and portable(seg.recipe[1])
    return Segmentation(recoded, label, chains=chains if plain else None), total


def _readdressed(done: DataFrame, base: int, copy_annotations: bool) -> DataFrame:
    """Recoded segments, whose text is beside their content, with their new addresses; those of new strings begin at base."""
    changed = F.col("text") != F.col("content")
    # inside a string, the ordinals of what was changed decide which unchanged ones get pointers
    w = W.partitionBy("str_index").orderBy("ord")
    d = done.withColumn("changed", changed)
    d = d.withColumn("kept_before", F.sum((~F.col("changed")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)))
    point = ~F.col("changed") & F.coalesce(F.lag("changed").over(w), F.lit(False)) & (F.coalesce("kept_before", F.lit(0)) > 0)
    d = d.withColumn("point", point).withColumn("pointer", F.max(F.when(F.col("point"), F.col("ord"))).over(w))
    new_index = F.when(F.col("changed"), base + F.col("ord")).when(F.col("pointer").isNotNull(), base + F.col("pointer")).otherwise(F.col("str_index"))
    return d.select(
        "ord",
        new_index.alias("str_index"),
        F.when(F.col("changed"), base + F.col("ord")).otherwise(F.col("real_str_index")).alias("real_str_index"),
        F.when(F.col("changed"), 0).otherwise(F.col("start")).alias("start"),
        F.when(F.col("changed"), F.length("text")).otherwise(F.col("end")).alias("end"),
        (F.col("annotations") if copy_annotations else no_annotations()).alias("annotations"),
        F.col("text").alias("content"),
    )
