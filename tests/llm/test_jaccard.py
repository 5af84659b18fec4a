import random
import re

import pytest

from spanloom.llm import jaccard as j
from spanloom.llm.components import components
from tests.llm.helpers import clashing, docs, odd, prose


def grams(text, n=j.N):
    w = re.findall("[a-z0-9_\x80-\U0010ffff]+", text.lower())
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute(rows, tau=j.TAU):
    sets = {}
    for d, t in rows:
        if d is not None and t is not None and grams(t):
            sets.setdefault(grams(t), set()).add(d)
    out = {(min(ids), d): 1.0 for ids in sets.values() for d in ids if d != min(ids)}
    items = [(s, min(ids)) for s, ids in sets.items()]
    for i, (s, a) in enumerate(items):
        for t, b in items[:i]:
            both = len(s & t)
            if both and both / (len(s) + len(t) - both) >= tau - 1e-12 and a != b:
                out[(min(a, b), max(a, b))] = round(both / (len(s) + len(t) - both), 6)
    return out


def near_corpus(seed, n=60):
    """Texts of any length, each with a copy that has some of its words changed."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(f"{seed}-{i}", int(3 * 1.12**i) + 1).split()
        rows.append((2 * i, " ".join(words)))
        change = r.choice([0.02, 0.08, 0.12, 0.2])
        rows.append((2 * i + 1, " ".join(f"c{r.random()}" if r.random() < change else w for w in words)))
    return rows


def found(df, **kw):
    return {(r.doc_a, r.doc_b): r.jaccard for r in j.near_pairs(df, **kw).collect()}


def classed(rows, pairs):
    """{doc_id: (class_id, links, copies)} of documents with one text each."""
    sets = {}
    for d, t in rows:
        if d is not None and t is not None and grams(t):
            sets.setdefault(grams(t), set()).add(d)
    first = {d: min(ids) for ids in sets.values() for d in ids}
    root = {d: d for d in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(first, 0)
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
        if first[a] != first[b]:
            links[a] += 1
            links[b] += 1
    size = {min(ids): len(ids) for ids in sets.values()}
    return {d: (find(d), links[first[d]], size[first[d]] - 1) for d in first}


def classes_of(df, **kw):
    return {r.doc_id: (r.class_id, r.links, r.copies) for r in j.classes(df, **kw).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_all_pairs_are_found(spark, seed):
    rows = near_corpus(seed)
    want, got = brute(rows), found(docs(spark, rows))
    assert len(want) > 25 and got == pytest.approx(want, abs=1e-6)
    assert classes_of(docs(spark, rows)) == classed(rows, want)


def test_pairs_just_at_tau(spark):
    """Sets of every band whose similarity is at tau or a little over: the hardest pairs."""
    r, rows = random.Random(4), []
    for i in range(60):
        n = int(14 * 1.1**i)
        words = [f"{i}x{k}" for k in range(n)]
        cut = int(n * 0.6) + 2
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:cut]))]
        r.random()
    want = brute(rows)
    assert len(want) == 60 and min(want.values()) >= 0.6 and sorted(want.values())[30] < 0.65
    assert found(docs(spark, rows)) == pytest.approx(want, abs=1e-6)


def test_the_plan_keeps_its_promise():
    """Misses of a pair at tau, by many draws of its elements' hashes, are as rare as the docstring says."""
    import numpy as np

    rng, missed = np.random.default_rng(3), 0
    for k in range(400):
        n = int(rng.integers(14, 3000))
        shared = int(np.ceil(0.6 * 2 * n / 1.6))
        a = rng.integers(0, 1 << 40, 2 * n - shared).astype(np.uint64)
        x, y = np.sort(a[:n]), np.sort(a[n - shared :])
        keys = [{int(v) for block in j.keys_of(e, np.array([len(e)]), np.array([k]), 0.6) for v in block[0]} for e in (x, y)]
        missed += not keys[0] & keys[1]
    assert missed <= 3


def test_small_sets_exactly(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(0, 9)))) for i in range(150)]
    assert found(docs(spark, rows)) == pytest.approx(brute(rows))


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    assert found(df) == pytest.approx(want, abs=1e-6) and classes_of(df) == classed(rows, want)


def test_many_copies(spark):
    text = prose(5, 120)
    got = found(docs(spark, [(i, text) for i in range(500)]))
    assert set(got) == {(0, i) for i in range(1, 500)}
    assert set(classes_of(docs(spark, [(i, text) for i in range(500)])).items()) == {(i, (0, 0, 499)) for i in range(500)}


def test_large_blocks_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(j, "TILE_PAIRS", 3)
    base = prose(6, 80).split()
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 80, 4))]
    assert found(docs(spark, rows)) == pytest.approx(brute(rows))


def family(seed, n, words=120, change=0.05):
    """Copies of one text, each with other words changed, some of them as in other copies."""
    r, base = random.Random(seed), [f"w{k}" for k in range(words)]
    return [" ".join(f"{w}c{r.randrange(9)}" if r.random() < change else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("piece", [2048, 16])
def test_links_of_large_groups_are_counted_not_listed(spark, monkeypatch, piece):
    """A group of n near copies gives rows in proportion to n; its links are those of brute force, however it is cut."""
    monkeypatch.setattr(j, "PIECE_SETS", piece)
    monkeypatch.setattr(j, "TILE_PAIRS", 50_000 if piece == 2048 else 300)
    other = [" ".join(t.split()[:70] + [f"v{k}" for k in range(50)]) for t in family(2, 60)]
    rows = list(enumerate(family(1, 150) + other + family(3, 40, 30, 0.1) + family(4, 30, 9, 0.1)))
    want, rowed = brute(rows), []
    assert len(want) > 10_000
    kept = j.materialize

    def watch(df, name):
        out = kept(df, name)
        rowed.append((out.count(), name))
        return out

    monkeypatch.setattr(j, "materialize", watch)
    df = docs(spark, rows)
    assert classes_of(df) == classed(rows, want)
    if piece == 2048:
        assert max(x for x in rowed if x[1] != "meetings")[0] < 12 * len(rows) < len(want)
    assert found(df) == pytest.approx(want, abs=1e-6)


def test_matrices_against_sets():
    import numpy as np

    r = np.random.default_rng(5)
    base = r.choice(900, 60, replace=False)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(30, 60), replace=False), r.choice(900, 14)])).astype(np.uint64) for _ in range(70)]
    near, common = j._alike(sets[:40], sets[25:], 0.45)
    for a, x in enumerate(sets[:40]):
        for b, y in enumerate(sets[25:]):
            both = len({*x.tolist()} & {*y.tolist()})
            assert common[a, b] == both and near[a, b] == (both / (len(x) + len(y) - both) >= 0.45 - 1e-12)
    assert 0 < near.sum() < near.size
    assert not j._common([x for x in sets[:2]], [sets[0] + np.uint64(1000)]).any()


def test_forest_connects_what_links_connect():
    import numpy as np

    r = np.random.default_rng(6)
    for density in (0.01, 0.04, 0.3):
        near = r.random((30, 40)) < density
        edges = [(int(a), 100 + int(b)) for a, b in zip(*np.nonzero(near), strict=True)]
        rr, i, rc, c = j._forest(near)
        few = [*zip(rr.tolist(), i.tolist()), *((int(a), 100 + int(b)) for a, b in zip(rc, c, strict=True))]

        def parts(pairs):
            root = {}
            for a, b in pairs:
                x, y = root.get(a, {a}), root.get(b, {b})
                root |= dict.fromkeys(x | y, x | y)
            return {frozenset(x) for x in root.values()}

        assert parts(few) == parts(edges) and len(few) <= 70


def test_odd_rows(spark):
    df = clashing(odd(spark).unionByName(docs(spark, [(30, prose(2, 100)), (30, prose(2, 100) + " more"), (31, prose(2, 100))])))
    assert set(found(df)) == {(30, 31)}
    kept = j.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 30, 30]
    assert found(df.limit(0)) == {} and j.dedup(df.limit(0)).count() == 0
    got = sorted((r.doc_id, r.class_id, r.links, r.copies) for r in j.classes(df).collect())
    assert got == [(4, 4, 0, 0), (5, 5, 0, 0), (6, 6, 0, 0), (7, 7, 0, 0), (30, 30, 0, 0), (30, 30, 0, 1), (31, 30, 0, 1)]
    assert j.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [7, 8])
def test_dedup_keeps_one_of_each_group(spark, seed):
    rows = near_corpus(seed, 40)
    want = classed(rows, brute(rows))
    assert {r.doc_id for r in j.dedup(docs(spark, rows)).collect()} == {c for c, _, _ in want.values()} | {d for d, t in rows if not grams(t)}


def test_dedup_of_chains_and_mixed_keys(spark):
    """Near copies that are near only to some of their group, and strangers that share its keys."""
    base, rows = prose(6, 120).split(), []
    for i in range(30):
        rows.append((i, " ".join(base[2 * i :] + [f"t{i}-{k}" for k in range(2 * i)])))
    for i in range(30, 45):
        rows.append((i, " ".join(base[:40] + [f"s{i}-{k}" for k in range(60)])))
    want = classed(rows, brute(rows))
    assert len({c for c, _, _ in want.values()}) > 10
    assert {r.doc_id for r in j.dedup(docs(spark, rows)).collect()} == {c for c, _, _ in want.values()}
    assert classes_of(docs(spark, rows)) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 3)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
