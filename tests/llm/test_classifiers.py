import math

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import quality, toxicity
from spanloom.llm.common import text_bytes
from spanloom.llm.labelled import best_threshold, collected, one_row_each, sample, shrunk
from tests.llm.helpers import clashing, docs, odd, prose


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


def held_out(spark, d, target, positive):
    """Labelled documents in two halves by id: the model sees the labels of one only."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return labels.where("doc_id % 2 = 0"), {r.doc_id: getattr(r, target) == positive for r in labels.where("doc_id % 2 = 1").collect()}


def test_quality_held_out(spark, larger):
    docs_ = spark.read.parquet(f"{larger}/documents.parquet")
    train, want = held_out(spark, larger, "quality", 1)
    got = {r.doc_id: r.keep for r in quality.classify(docs_, quality.fit(docs_, train)).collect() if r.doc_id in want}
    assert np.mean([got[d] == y for d, y in want.items()]) >= 0.9
    assert np.mean([got[d] for d, y in want.items() if y]) >= 0.95


def test_toxicity_held_out(spark, larger):
    docs_ = spark.read.parquet(f"{larger}/documents.parquet")
    train, want = held_out(spark, larger, "toxic", 1)
    got = {r.doc_id: r.toxic for r in toxicity.classify(docs_, toxicity.fit(docs_, train)).collect() if r.doc_id in want}
    assert np.mean([got[d] for d, y in want.items() if y]) >= 0.8
    assert np.mean([got[d] for d, y in want.items() if not y]) <= 0.02


def planted(spark):
    """Clean prose, junk, and prose with toxic words, with labels."""
    rows, labels = [], []
    for i in range(240):
        text = prose(i, 80, 300)
        kind = i % 4
        if kind == 1:
            text = " ".join(f"{w}%%% ###" for w in text.split())
        if kind == 2:
            words = text.split()
            words[10 + i % 50 : 10 + i % 50] = ["horrid", "stupid", "oaf"]
            text = " ".join(words)
        rows.append((i, text, "en" if i % 3 else "fr"))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def models(spark):
    d, labels = planted(spark)
    return d, quality.fit(d, labels), toxicity.fit(d, labels)


def test_planted(models):
    d, q, t = models
    got = {r.doc_id: r.keep for r in quality.classify(d, q).collect()}
    assert all(got[i] == (i % 4 != 1) for i in got)
    got = {r.doc_id: r.toxic for r in toxicity.classify(d, t).collect()}
    assert np.mean([got[i] == (i % 4 == 2) for i in got]) >= 0.97
    assert {r.doc_id for r in quality.filter_docs(d, q).collect()} == {i for i in got if i % 4 != 1}
    kept = {r.doc_id for r in toxicity.filter_docs(d, t).collect()}
    assert kept == {i for i in got if not got[i]}


def test_odd_rows(spark, models):
    _, q, t = models
    df = clashing(odd(spark))
    rows = quality.classify(df, q).collect()
    assert len(rows) == df.count() and all(r.score is None and r.keep for r in rows if r.doc_id in (1, 2, 3, 8))
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    kept = quality.filter_docs(df, q)
    assert kept.columns == df.columns and {1, 2, 3, 8} <= {r.doc_id for r in kept.collect()}
    rows = toxicity.classify(df, t).collect()
    assert len(rows) == df.count() and all(r.score is None and not r.toxic for r in rows if r.doc_id in (1, 2, 3, 8))
    kept = toxicity.filter_docs(df, t)
    assert kept.columns == df.columns and {1, 2, 3, 8} <= {r.doc_id for r in kept.collect()}
    for f in (lambda x: quality.classify(x, q), lambda x: quality.filter_docs(x, q), lambda x: toxicity.classify(x, t), lambda x: toxicity.filter_docs(x, t)):
        assert f(df.limit(0)).count() == 0


def test_no_model(spark):
    df = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert quality.fit(df, labels) is None and toxicity.fit(df, labels) is None
    assert quality.filter_docs(df, None).count() == df.count() == toxicity.filter_docs(df, None).count()
    assert all(r.keep and r.score is None for r in quality.classify(df, None).collect())
    assert not any(r.toxic for r in toxicity.classify(df, None).collect())


def test_whole_text_is_read(models):
    """A word at the end of a very long text counts."""
    d, _, t = models
    spark = d.sparkSession
    clean = " ".join(prose(i, 80, 300) for i in range(400))
    got = {r.doc_id: r.score for r in toxicity.classify(docs(spark, [(1, clean), (2, clean + " horrid stupid oaf")]), t).collect()}
    assert got[2] > got[1] + 0.2


def test_batches_dont_change_scores(models):
    """Scoring alone or among others is the same."""
    d, q, t = models
    texts = [r.text for r in d.orderBy("doc_id").limit(9).collect()] + ["", "one"]
    import pyarrow as pa

    from spanloom.llm.common import text_bytes

    together = quality.score(q, *quality.passages(*text_bytes(pa.array(texts))))
    alone = [quality.score(q, *quality.passages(*text_bytes(pa.array([x]))))[0] for x in texts]
    assert np.allclose(together, alone, equal_nan=True, atol=1e-5)
    p = t.projected()
    together = toxicity.score(t, p, *toxicity.subwords(*text_bytes(pa.array(texts))))
    alone = [toxicity.score(t, p, *toxicity.subwords(*text_bytes(pa.array([x]))))[0] for x in texts]
    assert np.allclose(together, alone, equal_nan=True, atol=1e-5)


def loop_quality(m, text):
    """The forward pass by plain loops over the passages of one text."""
    words, passages = text.split(), []
    for lo in range(0, len(words), quality.PASSAGE_WORDS):
        x = quality.passages(*text_bytes(pa.array([text])))[0][lo // quality.PASSAGE_WORDS]
        h = [max(0.0, sum(float(x[i]) * float(m.w1[i, j]) for i in range(len(x)) if x[i])) for j in range(m.w1.shape[1])]
        gate = 0.0
        for g in range(m.v.shape[1]):
            t = math.tanh(sum(h[j] * float(m.v[j, g]) for j in range(len(h))))
            u = 1 / (1 + math.exp(-sum(h[j] * float(m.u[j, g]) for j in range(len(h)))))
            gate += t * u * float(m.a[g])
        passages.append((gate, h))
    top = sum(math.exp(g) for g, _ in passages)
    z = [sum(math.exp(g) / top * h[j] for g, h in passages) for j in range(m.w1.shape[1])]
    return 1 / (1 + math.exp(-(sum(z[j] * float(m.c[j]) for j in range(len(z))) + float(m.c[-1]))))


def loop_toxicity(m, text):
    """The forward pass by plain loops over the places of every filter in one text."""
    idx, _ = toxicity.subwords(*text_bytes(pa.array([text.lower()])))
    x = [[sum(float(m.tables[k, row[k], d]) for k in range(toxicity.KINDS)) for d in range(toxicity.DIM)] for row in idx]
    logit = m.out_bias
    for c, (w, f) in enumerate(m.filters.items()):
        for n in range(toxicity.FILTERS):
            at = c * toxicity.FILTERS + n
            best = 0.0
            for i in range(len(x) - w + 1):
                best = max(best, sum(x[i + j][d] * float(f[j, d, n]) for j in range(w) for d in range(toxicity.DIM)) + float(m.bias[at]))
            logit += best * float(m.out[at])
    return 1 / (1 + math.exp(-logit))


def test_forward_by_brute_force(models):
    """The registered queries' scores are those of plain loops."""
    d, q, t = models
    few = d.where("doc_id < 12")
    for r in few.join(quality.classify(few, q), "doc_id").collect():
        assert r.score == pytest.approx(loop_quality(q, r.text), abs=2e-4) and r.keep == (r.score > q.threshold)
    for r in few.drop("lang").join(toxicity.classify(few, t), "doc_id").collect():
        assert r.score == pytest.approx(loop_toxicity(t, r.text), abs=2e-4) and r.toxic == (r.score >= t.thresholds.get(r.lang, t.threshold))


def slope(f, x, at, step=1e-5):
    was = x[at]
    x[at] = was + step
    up = f()
    x[at] = was - step
    down = f()
    x[at] = was
    return (up - down) / (2 * step)


def test_quality_gradients():
    r = np.random.default_rng(0)
    m = quality.Mil(*(r.normal(0, 0.4, s) for s in ((quality.DIMS, 5), (5, 3), (5, 3), 3, 6)))
    x, bags, y, w = r.normal(0, 0.5, (9, quality.DIMS)), np.array([2, 1, 4, 2]), np.array([1.0, 0, 1, 0]), np.array([0.3, 0.2, 0.1, 0.4])

    def loss():
        p = quality.score(m, x, bags)
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 5e-5 * (m.w1**2).sum())

    got = quality.gradients(m, x, bags, y, w)
    for name, g in got.items():
        par = getattr(m, name)
        for at in [tuple(r.integers(0, n) for n in par.shape) for _ in range(12)]:
            assert g[at] == pytest.approx(slope(loss, par, at), rel=1e-3, abs=1e-7), (name, at)


def test_toxicity_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 4)
    r = np.random.default_rng(1)
    nf = toxicity.FILTERS * len(toxicity.WIDTHS)
    m = toxicity.Cnn(r.normal(0, 1, (toxicity.KINDS, 16, toxicity.DIM)), {w: r.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS}, r.normal(0, 0.2, nf), r.normal(0, 0.5, nf), 0.1)
    rows = [r.integers(0, 16, (n, toxicity.KINDS)).astype(np.uint16) for n in (7, 1, 4, 2)]
    y, w = np.array([1.0, 0, 1, 0]), np.array([0.3, 0.2, 0.1, 0.4])

    def loss():
        x = [sum(m.tables[k][z[:, k]] for k in range(toxicity.KINDS)) for z in rows]
        total = 5e-5 * (m.out**2).sum()
        for z, yi, wi in zip(x, y, w, strict=True):
            pooled = np.concatenate([np.maximum(np.max([sum(z[i + j] @ f[j] for j in range(n)) + m.bias[c * toxicity.FILTERS : (c + 1) * toxicity.FILTERS] for i in range(len(z) - n + 1)] or [np.zeros(toxicity.FILTERS)], axis=0), 0) for c, (n, f) in enumerate(m.filters.items())])
            p = 1 / (1 + np.exp(-(pooled @ m.out + m.out_bias)))
            total += -wi * (yi * np.log(p) + (1 - yi) * np.log(1 - p))
        return float(total)

    g_out, g_ob, g_bias, g_filters, (at, words) = toxicity.gradients(m, rows, y, w)
    for g, par in ((g_out, m.out), (g_bias, m.bias), *((g_filters[n], m.filters[n]) for n in toxicity.WIDTHS)):
        for place in [tuple(r.integers(0, n) for n in par.shape) for _ in range(10)]:
            assert g[place] == pytest.approx(slope(loss, par, place), rel=1e-3, abs=1e-7)
    tables = np.zeros_like(m.tables)
    for k in range(toxicity.KINDS):
        np.add.at(tables[k], at[:, k], words)
    for place in [tuple(r.integers(0, n) for n in tables.shape) for _ in range(25)]:
        assert tables[place] == pytest.approx(slope(loss, m.tables, place), rel=1e-3, abs=1e-7)


def test_bytes_on_the_driver_are_bounded(spark):
    """A very long labelled text is passed over, the others are fitted; one row of each id is."""
    rows = [(i, "xx" * (1 + i)) for i in range(20)] + [(50, "y" * 5000), (3, "again")]
    df = one_row_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df.count() == 21
    t = collected(df, "text", 1000)
    assert 50 not in t.column("doc_id").to_pylist() and sum(len(x) for x in t.column("text").to_pylist()) <= 1000 and t.num_rows >= 19
    assert collected(df, "text", 10**6).num_rows == 21 and collected(df.limit(0), "text", 10).num_rows == 0
    d, labels = planted(spark)
    long = d.union(docs(spark, [(1000, prose(3, 200_000))]))
    more = labels.union(spark.createDataFrame([(1000, 1, 0)], labels.schema))
    assert quality.fit(long, more, train_bytes=2_000_000) and toxicity.fit(long, more, train_bytes=1_000_000)


def test_thresholds_by_language(models):
    """Every language with toxic and other rows has one, drawn towards the pooled one."""
    _, _, t = models
    assert set(t.thresholds) == {"en", "fr"}
    assert shrunk(0.9, 0.1, 0, 10) == pytest.approx(0.1) and 0.1 < shrunk(0.9, 0.1, 5, 10) < 0.5 and shrunk(0.9, 0.1, 1000, 10) > 0.88


def test_sample_and_threshold(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert {tuple(r) for r in sample(labels, "toxic", 10).collect()} == {(1, 1), (3, 0)}
    assert sample(labels, "toxic", 1).count() == 1
    assert best_threshold(np.array([0.9, 0.8, 0.2]), np.array([True, True, False]), 0.5) == pytest.approx(0.5)
    assert best_threshold(np.array([0.9]), np.array([True]), 0.7) == 0.7
