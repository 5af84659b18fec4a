"""Steps whose cost must not grow faster than their input: what they shuffle, and what they send to the driver."""

import re
from collections import Counter

import numpy as np
import pytest

from spanloom.operators import concordance, diversity
from spanloom.operators.concordance import cooc_in_window
from spanloom.operators.counting import count_in_chain, count_in_window
from spanloom.operators.diversity import variety_in_window
from spanloom.operators.segmentation import Segmentation
from spanloom.operators.segmenters import concatenate, recode, select, tokenize
from spanloom.plans import catalog
from spanloom.plans.session import materialize
from spanloom.sources.corpus import from_dataframe, with_pointers

TEXTS = [(1, "a b a c", "x"), (2, "b", "y"), (3, "a a b c d a b", "x"), (7, "d", "z"), (8, "c d", "x")]


@pytest.fixture(scope="module")
def u(spark):
    docs = from_dataframe(spark.createDataFrame(TEXTS, "id long, text string, kind string"), "id", "text", ["kind"])
    return tokenize(docs, [("[a-z]+", "tokenize")])


WORDS = [w for _, t, _ in TEXTS for w in t.split()]
KINDS = [k for _, t, k in TEXTS for _ in t.split()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_by(df) -> set[str]:
    """The columns by which a plan shuffles."""
    return {c for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan(df)) for c in re.findall(r"([A-Za-z_]\w*)#", keys)}


def test_iterate_stays_off_the_driver(spark, data, monkeypatch):
    def refuse(self):
        raise AssertionError("all segments were sent to the driver")

    monkeypatch.setattr(Segmentation, "__iter__", refuse)
    assert catalog.QUERIES["iterate"](spark, data).count() == catalog.QUERIES["tokenize_lines"](spark, data).count()


def test_each_sees_every_segment_once(u):
    got = u.each(lambda rows: ((r.ord, r.content, r.annotations["kind"]) for r in rows), "ord long, item string, kind string").collect()
    assert sorted(tuple(r) for r in got) == [(i, w, k) for i, (w, k) in enumerate(zip(WORDS, KINDS, strict=True))]


def windows(n: int, xs: list) -> list[list]:
    return [xs[i : i + n] for i in range(len(xs) - n + 1)]


def perplexity(xs) -> float:
    f = np.array(list(Counter(xs).values()), float)
    return float(np.exp(np.log(f.sum()) - (f * np.log(f)).sum() / f.sum()))


def by_category(xs, weighting: bool, category_weighting: bool) -> float:
    groups = {k: [w for w, c in xs if c == k] for _, k in xs}
    v = [perplexity(g) if weighting else len(set(g)) for g in groups.values()]
    return float(np.average(v, weights=[len(g) for g in groups.values()] if category_weighting else None))


def expected(xs, size: int) -> float:
    from itertools import combinations

    return float(np.mean([len(set(s)) for s in combinations(xs, size)]))


def values(t, column: str) -> list[float]:
    got = {int(r.context): r[column] for r in t.collect()}
    return [got[i + 1] for i in range(len(got))]


@pytest.mark.parametrize("n", [1, 2, 4, 9, 16])
def test_window_variety(u, n):
    t = variety_in_window(u, n)
    assert "context" not in shuffled_by(t)
    assert values(t, "variety") == [len(set(x)) for x in windows(n, WORDS)]


@pytest.mark.parametrize("n", [1, 3, 5])
def test_window_perplexity(u, n):
    t = variety_in_window(u, n, weighting=True)
    assert "context" not in shuffled_by(t)
    assert values(t, "variety") == pytest.approx([perplexity(x) for x in windows(n, WORDS)])


@pytest.mark.parametrize("n, size", [(4, 2), (5, 3), (3, 3)])
def test_window_expected_variety(u, n, size):
    t = variety_in_window(u, n, resample=True, subsample_size=size)
    assert "context" not in shuffled_by(t)
    assert values(t, "expected_variety") == pytest.approx([expected(x, size) for x in windows(n, WORDS)])


def test_window_too_short_for_the_draws(u):
    assert variety_in_window(u, 3, resample=True, subsample_size=4).count() == 0


@pytest.mark.parametrize("weighting", [False, True])
@pytest.mark.parametrize("category_weighting", [False, True])
def test_window_categories(u, weighting, category_weighting):
    t = variety_in_window(u, 5, per_category=True, category_key="kind", weighting=weighting, category_weighting=category_weighting)
    assert not {"context", "window"} & shuffled_by(t)
    pairs = list(zip(WORDS, KINDS, strict=True))
    assert values(t, "variety") == pytest.approx([by_category(x, weighting, category_weighting) for x in windows(5, pairs)])
    # kinds in the words' categories
    t = variety_in_window(u, 5, unit_key="kind", per_category=True, weighting=weighting, category_weighting=category_weighting)
    assert values(t, "variety") == pytest.approx([by_category([(k, w) for w, k in x], weighting, category_weighting) for x in windows(5, pairs)])
    t = variety_in_window(u, 5, per_category=True, weighting=weighting, category_weighting=category_weighting)
    assert values(t, "variety") == pytest.approx([1.0] * (len(WORDS) - 4))


@pytest.mark.parametrize("n, k", [(4, 1), (4, 2), (2, 2)])
def test_window_counts(u, n, k):
    t = count_in_window(u, n, seq_length=k).df
    assert "HigherOrder" not in plan(t) and "MapInArrow" in plan(t)
    want = {(str(i + 1), g): f for i, x in enumerate(windows(n, WORDS)) for g, f in Counter("#".join(y) for y in windows(k, x)).items()}
    assert {(r.row_id, r.col_id): r.value for r in t.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_window_pairs_are_counted_once(u, n):
    """Half of the table is counted, where the window is, and mirrored."""
    t = cooc_in_window(u, n).df
    assert "MapInArrow" in plan(t)
    want = Counter((a, b) for x in windows(n, WORDS) for a in set(x) for b in set(x))
    assert {(r.row_id, r.col_id): r.value for r in t.collect()} == want


def test_checksum_of_odd_rows(spark):
    import hashlib

    rows = [("é|", None), (None, 3), ("", -1)] + [(str(i), i) for i in range(30_000)]
    h = [hashlib.md5("|".join("~" if v is None else str(v) for v in r).encode()).hexdigest() for r in rows]
    want = {p: (sum(x[:2] == p for x in h), sum(int(x[2:10], 16) for x in h if x[:2] == p)) for p in {x[:2] for x in h}}
    df = spark.createDataFrame(rows, "a string, b long")
    t = catalog.checksum(df.repartition(3), "a", "b")
    assert "MapInArrow" in plan(t)
    assert {r.part: (r.n, r.digest) for r in t.collect()} == want
    assert catalog.checksum(df.where("false"), "a", "b").count() == 0


def test_recoded_chains_need_no_order(spark, u, monkeypatch):
    """Transitions of recoded words are read off the strings; no word is numbered, written or sorted."""
    monkeypatch.setattr(Segmentation, "ordered", property(lambda self: pytest.fail("all words were put in order")))
    t = count_in_chain(recode(u, [("b", "B")])[0]).df
    want = Counter()
    for _, text, _ in TEXTS:
        kept = [w for w in text.split() if w != "b"]
        want.update((a + "_", b) for a, b in zip(kept, kept[1:], strict=False))
    assert {(r.row_id, r.col_id): r.value for r in t.collect()} == want


def test_recoded_case_is_not_written(spark, u, monkeypatch):
    from spanloom.operators import segmenters

    monkeypatch.setattr(segmenters, "materialize", lambda df, name: pytest.fail(f"{name} was written") if name == "recoded" else materialize(df, name))
    out, total = recode(u, case="upper")
    assert [r.content for r in out.ordered.orderBy("ord").collect()] == [w.upper() for w in WORDS] and total.first()[0] == 0
    assert min(r.str_index for r in out.df.collect()) == 9


def test_patterns_merge_inside_their_string(spark):
    docs = from_dataframe(spark.createDataFrame([(1, "a 1 22 b3", "x"), (2, "7", "y"), (3, "-", "z")], "id long, text string, kind string"), "id", "text", ["kind"])
    seg = tokenize(docs, [(r"\w+", "tokenize", {"t": "word"}), ("[0-9]+", "tokenize", {"t": "number", "d": "yes"}), (" ", "split", {"s": "part"})], merge=True)
    assert not {"start", "str_index"} & shuffled_by(seg.df)
    got = [(r.str_index, r.content, dict(r.annotations)) for r in seg.ordered.orderBy("ord").collect()]
    num, word, part = {"t": "number", "d": "yes"}, {"t": "word"}, {"s": "part"}
    want = [(1, "a", word | part), (1, "1", num | part), (1, "22", num | part), (1, "b3", word | part), (1, "3", num), (2, "7", num | part), (3, "-", part)]
    assert got == [(i, c, a | {"kind": "xxyz"[i]}) for i, c, a in want]


@pytest.mark.parametrize("merge", [False, True])
@pytest.mark.parametrize("order", [False, True])
def test_concatenation_shuffles_strings(spark, merge, order):
    rows = [(1, "a b\nc", "x"), (2, "d", "y"), (5, "\n", "z"), (7, "1 e\n2", "x"), (9, "3", "y")]
    docs = from_dataframe(spark.createDataFrame(rows, "id long, text string, kind string"), "id", "text", ["kind"])
    lines, words = tokenize(docs, [(r"[^\n]+", "tokenize")], "lines"), tokenize(docs, [(r"[\p{L}\p{N}]+", "tokenize")], "words")
    inputs = [select(words, "[0-9]", label="numbers")[0], lines, words]
    both = concatenate(inputs, sort=order, merge=merge)
    assert not {"start", "end"} & shuffled_by(both.df)
    got = [(r.str_index, r.start, r.end, r.annotations["component_label"], r.annotations["kind"], r.content) for r in both.ordered.orderBy("ord").collect()]
    for s in inputs:
        s.cuts = None
    plain = concatenate(inputs, sort=order, merge=merge)
    assert got == [(r.str_index, r.start, r.end, r.annotations["component_label"], r.annotations["kind"], r.content) for r in plain.ordered.orderBy("ord").collect()]
    assert len(got) == (10 if merge else 17)


def test_only_strings_with_units_meet_their_tokens(spark, monkeypatch):
    rows = [(1, "a 1 b", "x"), (2, "2", "y"), (3, "c d e", "x"), (4, "3 f", "x")]
    docs = from_dataframe(spark.createDataFrame(rows, "id long, text string, kind string"), "id", "text", ["kind"])
    words = tokenize(docs, [("[a-z0-9]+", "tokenize")])
    units = select(words, "^[0-9]+$")[0]
    monkeypatch.setattr(concordance, "contained", lambda *_: pytest.fail("all tokens were joined by place"))
    got = [tuple(r) for r in concordance.neighbors(units, words, max_distance=2).orderBy("id").collect()]
    assert got == [(1, 2, None, "a", "1", "b", None), (2, 4, None, None, "2", None, None), (3, 8, None, None, "3", "f", None)]
    got = [tuple(r) for r in concordance.neighbors(units, words, max_distance=2, merge_strings=True).orderBy("id").collect()]
    assert got == [(1, 2, None, "a", "1", "b", "2"), (2, 4, "1", "b", "2", "c", "d"), (3, 8, "d", "e", "3", "f", None)]
    for merge, want in ((False, {"a": 1, "b": 1, "f": 1}), (True, {"a": 1, "b": 1, "f": 1, "c": 1, "d": 1, "e": 1, "1": 1, "2": 1})):
        t = concordance.collocations(units, words, max_distance=2, merge_strings=merge)
        assert {r.unit: r.local_freq for r in t.collect()} == want


def test_pointer_chains_need_no_order(spark, monkeypatch):
    docs = from_dataframe(spark.createDataFrame([(1, "a b c"), (2, "d"), (3, "e f")], "id long, text string"), "id", "text")
    more = with_pointers(docs, spark.createDataFrame([(11, 1), (12, 2), (13, 2)], "str_index long, target long"))
    monkeypatch.setattr(Segmentation, "token_offsets", lambda self: pytest.fail("all words were numbered"))
    for left, right in ((1, 0), (2, 1)):
        n = left + right + 1
        want = Counter(("#".join(x[:left]) + "_" + "#".join(x[left + 1 :]), x[left]) for xs in ("abcabc", "ddd", "ef") for x in windows(n, list(xs)))
        t = count_in_chain(tokenize(more, [("[a-z]+", "tokenize")]), left, right).df
        assert {(r.row_id, r.col_id): r.value for r in t.collect()} == want


def test_resampling_counts_tokens_in_place(spark, monkeypatch):
    """Categories of plain tokens are their strings', so no token is joined with its context."""
    monkeypatch.setattr(diversity, "contained", lambda *_: pytest.fail("all tokens were joined with their contexts"))
    rows = [(i, "a b c d e f g h", "xy"[i % 2], "uv"[i // 4]) for i in range(8)]
    docs = from_dataframe(spark.createDataFrame(rows, "id long, text string, kind string, part string"), "id", "text", ["kind", "part"])
    t = diversity.variety_in_context(tokenize(docs, [("[a-z]+", "tokenize")]), docs, per_category=True, category_key="kind", context_key="part", adjust=False, resample=True, subsample_size=32, num_subsamples=3)
    assert {r.context: (r.variety_average, r.variety_std_deviation, r.variety_count) for r in t.collect()} == {"u": (8.0, 0.0, 3), "v": (8.0, 0.0, 3)}
