"""Counts, lengths, diversity, concordances and tables on small corpora with results worked out by hand."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanloom.operators.annotate import annotate_contexts
from spanloom.operators.concordance import collocations, context, cooc_in_context, cooc_in_window, neighbors
from spanloom.operators.counting import count_in_chain, count_in_context, count_in_window
from spanloom.operators.diversity import adjusted_size, expected_variety, variety_in_context, variety_in_window
from spanloom.operators.lengths import length_in_context, length_in_window
from spanloom.operators.segmenters import tokenize
from spanloom.operators.table import CrossTab
from spanloom.sources.corpus import from_spans, from_text, from_texts
from spanloom.streaming.counts import stream_counts


def cells(t):
    return {(r.row_id, r.col_id): r.value for r in t.df.collect()}


def rows(df):
    return {r[0]: tuple(round(x, 6) if isinstance(x, float) else x for x in r[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def abac(spark):
    return tokenize(from_text(spark, "a b a c"), [(r"\w", "tokenize")])


@pytest.fixture(scope="module")
def two(spark):
    """Two strings of words, lines as contexts."""
    return from_texts(spark, ["a b\na c", "b a"])


def test_counts(abac):
    assert cells(count_in_context(abac, seq_length=2)) == {("__global__", x): 1 for x in ("a#b", "b#a", "a#c")}
    w = count_in_window(abac, 3)
    assert cells(w) == {("1", "a"): 2, ("1", "b"): 1, ("2", "a"): 1, ("2", "b"): 1, ("2", "c"): 1}
    assert cells(count_in_chain(abac)) == {("a_", "b"): 1, ("b_", "a"): 1, ("a_", "c"): 1}
    assert cells(count_in_window(abac, 9)) == {}


def test_counts_in_lines(two):
    words, lines = tokenize(two, [(r"\w", "tokenize")]), tokenize(two, [(r"[^\n]+", "tokenize")])
    assert cells(count_in_context(words, lines)) == {("a b", "a"): 1, ("a b", "b"): 1, ("a c", "a"): 1, ("a c", "c"): 1, ("b a", "a"): 1, ("b a", "b"): 1}
    assert cells(count_in_context(words, lines, seq_length=2, merge_contexts=True)) == {("__global__", x): 1 for x in ("a#b", "a#c", "b#a")}
    # across strings the last and first words meet
    assert cells(count_in_context(words, seq_length=2))[("__global__", "c#b")] == 1
    assert ("c_", "b") not in cells(count_in_chain(words)) and ("c_", "b") in cells(count_in_chain(words, merge_strings=True))


def test_overlapping_contexts(spark):
    s = from_text(spark, "abcd")
    ctx = from_spans(s, [(0, 0, 4), (0, 0, 2)])
    units = tokenize(ctx, [("[a-d]", "tokenize")])
    # each context also holds the tokens made from the other one
    assert cells(count_in_context(units, ctx))[("ab", "a")] == 2


def test_long_ngram_across_short_strings(spark):
    units = tokenize(from_texts(spark, ["a", "b", "c", "d e"]), [("[a-z]", "tokenize")])
    assert set(x for _, x in cells(count_in_context(units, seq_length=4))) == {"a#b#c#d", "b#c#d#e"}


def test_lengths(two):
    words, lines = tokenize(two, [(r"\w", "tokenize")]), tokenize(two, [(r"[^\n]+", "tokenize")])
    assert rows(length_in_context(words)) == {"__global__": (6,)}
    assert rows(length_in_context(words, contexts=two)) == {"a b\na c": (4,), "b a": (2,)}
    assert rows(length_in_context(words, contexts=lines, merge_contexts=True)) == {"__global__": (6,)}
    assert rows(length_in_context(words, lines, two, std_deviation=True)) == {"a b\na c": (2, 2, 0), "b a": (2, 1, 0)}
    assert rows(length_in_context(words, two, std_deviation=True)) == {"__global__": (3, 2, 1)}
    assert rows(length_in_window(words, two, 2, True)) == {1: (3, 2, 1)}
    assert rows(length_in_window(words, two, 3)) == {}
    assert rows(length_in_context(tokenize(two, [("z", "tokenize")]), contexts=two)) == {}


def test_sliding_blocks(spark):
    x = from_text(spark, "a aa aaa aaaa a aa")
    words, chars = tokenize(x, [(r"\w+", "tokenize")]), tokenize(x, [(r"\w", "tokenize")])
    n = [1, 2, 3, 4, 1, 2]
    from spanloom.operators import lengths

    old, lengths.sliding.__defaults__ = lengths.sliding.__defaults__, (2,)
    try:
        got = rows(length_in_window(chars, words, 1))
        assert got == {i + 1: (float(v), 1) for i, v in enumerate(n)}
        got = rows(length_in_window(chars, words, 3))
        assert got == {i + 1: (round(sum(n[i : i + 3]) / 3, 6), 3) for i in range(4)}
    finally:
        lengths.sliding.__defaults__ = old


def test_variety(abac):
    assert rows(variety_in_context(abac)) == {"__global__": (3,)}
    assert rows(variety_in_context(abac, weighting=True)) == {"__global__": (round(2 * math.sqrt(2), 6),)}
    assert rows(variety_in_context(abac, resample=True, subsample_size=2)) == {"__global__": (1.833333,)}
    assert rows(variety_in_context(abac, resample=True, subsample_size=4)) == {"__global__": (3,)}
    assert rows(variety_in_context(abac, resample=True, subsample_size=5)) == {}
    assert rows(variety_in_window(abac, 3)) == {"1": (2,), "2": (3,)}
    with pytest.raises(ValueError):
        variety_in_context(abac, per_category=True, seq_length=2)


def test_variety_per_category(spark):
    s = from_text(spark, "xyxzz")
    u = from_spans(s, [(0, i, i + 1, {"c": c}) for i, c in enumerate("AABBB")])
    one = rows(variety_in_context(u, per_category=True, category_key="c"))
    assert one == {"__global__": (2.0,)}
    v = rows(variety_in_context(u, per_category=True, category_key="c", weighting=True, category_weighting=True))["__global__"][0]
    pb = math.exp(math.log(3) - 2 * math.log(2) / 3)
    assert v == pytest.approx((2 * 2 + 3 * pb) / 5, abs=1e-6)
    assert rows(variety_in_window(u, 2, per_category=True, category_key="c"))["1"] == (2.0,)


def test_resampling(spark):
    u = tokenize(from_text(spark, "a a a b b c d e e e e f"), [(r"\w", "tokenize")])
    kw = dict(weighting=True, resample=True, num_subsamples=400, seed=3)
    got = variety_in_context(u, subsample_size=12, **kw).first()
    assert got.variety_std_deviation == pytest.approx(0, abs=1e-9) and got.variety_count == 400
    assert got.variety_average == pytest.approx(variety_in_context(u, weighting=True).first().variety)
    assert rows(variety_in_context(u, subsample_size=6, **kw)) == rows(variety_in_context(u, subsample_size=6, **kw))
    assert variety_in_context(u, subsample_size=13, **kw).count() == 0


def test_adjusted_resampling(spark):
    s = from_text(spark, "abcdefgh" * 3)
    u = from_spans(s, [(0, i, i + 1, {"c": "AB"[i % 2] if i < 12 else "A"}) for i in range(24)])
    got = variety_in_context(u, per_category=True, category_key="c", resample=True, subsample_size=10, num_subsamples=5)
    assert got.columns == ["context", "variety_average", "variety_std_deviation", "subsample_size", "variety_count"]
    assert 2 <= got.first().subsample_size <= 10
    plain = variety_in_context(u, per_category=True, category_key="c", adjust=False, resample=True, subsample_size=10, num_subsamples=5)
    assert "subsample_size" not in plain.columns
    # where both ends of the last step lie above the target, the lower one is taken
    assert adjusted_size(np.array([5, 5]), 8, 0.0) == 7
    assert adjusted_size(np.array([1, 1, 1, 1]), 4, 1.0) == 4


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(counts=st.lists(st.integers(1, 5), min_size=1, max_size=4), size=st.integers(1, 6))
def test_expected_variety_by_enumeration(spark, counts, size):
    df = spark.createDataFrame([("x", int(f)) for f in counts], "context string, f long")
    got = expected_variety(df, size).collect()
    tokens = [i for i, f in enumerate(counts) for _ in range(f)]
    if size > len(tokens):
        assert got == []
    else:
        samples = list(itertools.combinations(tokens, size))
        assert got[0].expected == pytest.approx(sum(len(set(x)) for x in samples) / len(samples))


def test_annotate(spark):
    s = from_texts(spark, ["b a b c", "c a"])
    u = tokenize(s, [(r"\w", "tokenize")])
    assert rows(annotate_contexts(u, s)) == {"b a b c": ("b",), "c a": ("c",)}
    assert rows(annotate_contexts(u, s, keep_only_first=False)) == {"b a b c": ("b|a|c",), "c a": ("c|a",)}
    assert rows(annotate_contexts(u, s, keep_only_first=False, reverse=False))["b a b c"] == ("a|c|b",)
    assert rows(annotate_contexts(u, s, sort_order="ASCII")) == {"b a b c": ("c",), "c a": ("c",)}
    assert rows(annotate_contexts(u, s, sort_order="ASCII", reverse=False, keep_only_first=False, value_delimiter=","))["c a"] == ("a,c",)
    assert rows(annotate_contexts(u, s, seq_length=2))["c a"] == ("c#a",)
    assert rows(annotate_contexts(u)) == {"__global__": ("b",)}


def test_context(spark, two):
    u, lines = tokenize(two, [("[bc]", "tokenize", {"k": "v"})]), tokenize(two, [(r"[^\n]+", "tokenize")])
    got = [tuple(r) for r in context(u, lines, unit_key="k").orderBy("id").collect()]
    assert got == [(1, 1, "a ", "b", None, "v"), (2, 2, "a ", "c", None, "v"), (3, 3, None, "b", " a", "v")]
    got = [tuple(r) for r in context(u, lines, "k", False, max_num_chars=1).orderBy("id").collect()]
    assert got[0] == (1, 1, " ", "v", None)


def test_neighbors(spark, two):
    words = tokenize(two, [(r"\w", "tokenize")])
    u = tokenize(two, [("c", "tokenize")])
    assert [tuple(r) for r in neighbors(u, words, max_distance=2).collect()] == [(1, 4, "b", "a", "c", None, None)]
    assert [tuple(r) for r in neighbors(u, words, max_distance=2, merge_strings=True).collect()] == [(1, 4, "b", "a", "c", "b", "a")]
    assert len(neighbors(u, words).columns) == 3 + 2 * 5


def test_collocations(spark, two):
    words = tokenize(two, [(r"\w", "tokenize")])
    u = tokenize(two, [("c", "tokenize")])
    got = rows(collocations(u, words, max_distance=2))
    assert got["a"] == (round(math.log2((1 / 2) / (3 / 6)), 6), 1, 0.5, 3, 0.5) and set(got) == {"a", "b"}
    assert set(rows(collocations(u, words, max_distance=2, min_frequency=3))) == {"a"}
    assert rows(collocations(u, words, max_distance=2, merge_strings=True))["b"][1] == 2
    assert rows(collocations(u, words))["a"][1] == 2 and rows(collocations(u, words, merge_strings=True))["a"][1] == 3


@pytest.fixture(scope="module")
def texte(spark):
    s = from_text(spark, "un texte")
    letters = tokenize(s, [(r"\w", "tokenize", {"type": "C"}), ("[aeiouy]", "tokenize", {"type": "V"})], merge=True)
    return letters, tokenize(s, [(r"\w+", "tokenize")])


def symmetric(spec):
    out = {}
    for x in spec.split():
        out[(x[0], x[1])] = out[(x[1], x[0])] = int(x[2:])
    return out


def test_cooc(texte):
    letters, words = texte
    assert cells(cooc_in_window(letters, 3, zeros=True)) == symmetric("uu1 un1 ut1 ue0 ux0 nn2 nt2 ne1 nx0 tt5 te4 tx3 ee4 ex3 xx3")
    assert set(cells(cooc_in_window(letters, 3, "type")).values()) == {5}
    want = symmetric("uu1 un1 nn1 tt1 te1 tx1 ee1 ex1 xx1")
    assert cells(cooc_in_context(letters, words)) == want
    full = cells(cooc_in_context(letters, words, zeros=True))
    assert len(full) == 25 and {k: v for k, v in full.items() if v} == want
    assert set(cells(cooc_in_context(letters, words, "type")).values()) == {2}


def test_cooc_two_units(spark, texte):
    from spanloom.operators.segmenters import select

    letters, words = texte
    v, c = select(letters, "V", annotation_key="type")
    assert cells(cooc_in_context(v, words, units2=c, zeros=True)) == {("n", "u"): 1, ("n", "e"): 0, ("t", "u"): 0, ("t", "e"): 1, ("x", "u"): 0, ("x", "e"): 1}
    assert cells(cooc_in_context(v, words, "type", units2=c, unit2_key="type")) == {("C", "V"): 2}


@pytest.fixture(scope="module")
def square(spark):
    return CrossTab.from_numpy(spark, ["ctx1", "ctx2"], ["u", "v"], np.array([[1, 3], [4, 2]]))


def test_normalize(square):
    def m(*a):
        return np.round(square.to_normalized(*a).to_numpy(), 6).tolist()

    assert m("rows", "l1") == [[0.25, 0.75], [0.666667, 0.333333]]
    assert m("columns", "l1") == [[0.2, 0.6], [0.8, 0.4]]
    assert m("table", "l1") == [[0.1, 0.3], [0.4, 0.2]]
    assert m("rows", "l2")[0] == [0.316228, 0.948683]
    assert m("quotients") == [[0.5, 1.5], [1.333333, 0.666667]]
    assert m("TF-IDF") == [[0, 0], [0, 0]] and m("presence/absence") == [[1, 1], [1, 1]]
    assert cells(square.to_document_frequency()) == {("__document_frequency__", "u"): 2, ("__document_frequency__", "v"): 2}
    e = cells(square.to_association_matrix("frequent"))
    assert {k: round(v, 6) for k, v in e.items()} == {("u", "u"): 0.291667, ("u", "v"): 0.208333, ("v", "u"): 0.208333, ("v", "v"): 0.291667}
    assert cells(square.to_association_matrix("none"))[("u", "u")] == pytest.approx(0.583333, abs=1e-6)
    for bad in (("rows", "l3"), ("other", "l1")):
        with pytest.raises(ValueError):
            square.to_normalized(*bad)


def test_conversions(spark, square):
    assert cells(square.to_transposed())[("u", "ctx2")] == 4
    flat = square.to_flat()
    assert flat.count() == 10 and cells(CrossTab.from_flat(flat)) == cells(square)
    assert cells(CrossTab.from_weighted_flat(square.to_weighted_flat())) == cells(square)
    assert square.to_numpy().tolist() == [[1, 3], [4, 2]]
    with pytest.raises(ValueError):
        CrossTab.from_numpy(spark, ["a"], ["b"], np.array([[0.5]]))
    assert square.to_string() == "__context__\tu\tv\nctx1\t1\t3\nctx2\t4\t2"
    assert square.to_string(typed_headers=True).split("\n")[1] == "string\tcontinuous\tcontinuous"
    by_u = square.to_sorted("u", reverse_rows=True)
    assert by_u.row_ids() == ["ctx2", "ctx1"] and square.to_sorted(key_row="ctx1", reverse_cols=True).col_ids() == ["v", "u"]
    table, roles = square.to_ml()
    assert list(table.columns) == ["row_id", "u", "v"] and roles["u"] == "continuous"
    assert [r.unit for r in square.top_units().collect()] == ["u", "v"] and square.copy() == square
    assert sorted(r.col_id for r in square.unique("col").collect()) == ["u", "v"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a b a", "x"), (None, "y")], "text string, lang string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, lang string").parquet(str(tmp_path / "in"))
    q = stream_counts(stream, "[a-z]", context_col="lang").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.context, r.unit): r.value for r in spark.table("counted").collect()} == {("x", "a"): 2, ("x", "b"): 1}


def test_invariants(spark, data):
    from spanloom.plans import catalog

    x = catalog.docs(spark, data)
    words = tokenize(x, [(catalog.WORD, "tokenize")])
    t = count_in_context(words, x, context_key="lang")
    assert t.df.agg({"value": "sum"}).first()[0] == words.count()
    sums = t.to_normalized("rows").df.groupBy("row_id").agg({"value": "sum"}).collect()
    assert all(r[1] == pytest.approx(1) for r in sums)
    slow = count_in_context(tokenize(x, [(r"[\p{L}\p{N}_]+(?:)", "tokenize")]), x, context_key="lang")
    assert Counter(map(tuple, slow.df.collect())) == Counter(map(tuple, t.df.collect()))


def _exact(counts, size, measure):
    """Mean and deviation of a measure over all samples of size tokens."""
    tokens = [u for u, n in counts.items() for _ in range(n)]
    got = np.array([measure(Counter(x)) for x in itertools.combinations(tokens, size)])
    return got.mean(), got.std()


def _perplexity_of(c):
    n = sum(c.values())
    return math.exp(math.log(n) - sum(k * math.log(k) for k in c.values()) / n)


@pytest.mark.parametrize("size", [2, 3, 5])
def test_resampled_perplexity_against_enumeration(spark, size):
    """Mean and deviation of many samples against all samples there are."""
    words = tokenize(from_text(spark, "a a a b b c d"), [("[a-z]", "tokenize")])
    r = variety_in_context(words, weighting=True, resample=True, subsample_size=size, num_subsamples=6000).first()
    mean, std = _exact(Counter("aaabbcd"), size, _perplexity_of)
    assert r.variety_average == pytest.approx(mean, abs=5 * std / 6000**0.5 + 1e-9) and r.variety_std_deviation == pytest.approx(std, rel=0.05, abs=1e-9)
    assert r.variety_count == 6000


def test_resampled_categories_against_enumeration(spark):
    """Mean variety of two categories without adjustment, weighted and not, against all samples there are."""
    words = tokenize(from_text(spark, "ax ax ay bx bz bz"), [("a.", "tokenize", {"k": "a"}), ("b.", "tokenize", {"k": "b"})])

    def measure(weighted):
        def f(c):
            per = {}
            for u, n in c.items():
                v, w = per.get(u[0], (0, 0))
                per[u[0]] = (v + 1, w + n)
            return float(np.average([v for v, _ in per.values()], weights=[w for _, w in per.values()] if weighted else None))

        return f

    for weighted in (False, True):
        r = variety_in_context(words, per_category=True, category_key="k", category_weighting=weighted, adjust=False, resample=True, subsample_size=3, num_subsamples=6000).first()
        mean, std = _exact(Counter("ax ax ay bx bz bz".split()), 3, measure(weighted))
        assert r.variety_average == pytest.approx(mean, abs=5 * std / 6000**0.5) and r.variety_std_deviation == pytest.approx(std, rel=0.05)


def test_job(spark):
    from spanloom.plans.jobs import job, run_cancellable

    with job(spark, "counting") as j:
        assert spark.range(10).count() == 10
    assert j.progress().done >= 1
    j, t, out = run_cancellable(spark, lambda: spark.range(5).count())
    t.join()
    assert out == [5]
