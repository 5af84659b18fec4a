"""Co-occurrence and association over all words, rare ones too, by brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.operators.counting import count_in_context
from spanloom.plans import catalog

TEXTS = ["a b b c", "b c d", "e", "a e, a\nb a c\na\n", None, ""]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return d


def counts():
    words = [re.findall(r"\w+", x) for x in {x for t in TEXTS for x in (t or "").split("\n")}]
    types = sorted({w for x in words for w in x})
    f = np.array([[x.count(w) for w in types] for x in words if x], float)
    return f, types


def digest(rows):
    """The catalogue's checksum, by definition."""
    out = {}
    for row in rows:
        h = hashlib.md5("|".join(map(str, row)).encode()).hexdigest()
        n, total = out.get(h[:2], (0, 0))
        out[h[:2]] = (n + 1, total + int(h[2:10], 16))
    return out


def test_cooc_context(spark, folder):
    f, types = counts()
    t = (f > 0).astype(int).T @ (f > 0).astype(int)
    want = [(x, y, t[i, j]) for i, x in enumerate(types) for j, y in enumerate(types) if t[i, j]]
    got = {r.part: (r.n, r.digest) for r in catalog.QUERIES["cooc_context"](spark, folder).collect()}
    assert got == digest(want)


def test_cooc_two_units(spark, folder):
    got = {(r.row_id, r.col_id): r.value for r in catalog.QUERIES["cooc_two_units"](spark, folder).collect()}
    held, spoken = {}, {}
    for i, t in enumerate(TEXTS):
        if t is not None:
            held.setdefault(i % 3, set()).update(re.findall(r"\w+", t))
            spoken.setdefault(i % 3, set()).add("en" if i % 2 else "de")
    assert got == Counter((g, w) for s in held for w in held[s] for g in spoken[s])


@pytest.mark.parametrize("bias", ["frequent", "none", "rare"])
def test_association(spark, folder, bias):
    f, types = counts()
    w = f.sum(0) / f.sum()
    e = f.T @ (f / f.sum(1, keepdims=True)) / f.sum()
    e = e / {"frequent": 1, "none": np.sqrt(np.outer(w, w)), "rare": np.outer(w, w)}[bias]
    units, contexts = catalog._by_line(spark, folder)
    got = {(r.row_id, r.col_id): r.value for r in count_in_context(units, contexts).to_association_matrix(bias).df.collect()}
    want = {(x, y): e[i, j] for i, x in enumerate(types) for j, y in enumerate(types) if e[i, j] > 0}
    assert got == pytest.approx(want)
    if bias == "none":
        rows = {r.row_id: (r.cells, r.value) for r in catalog.QUERIES["association_words"](spark, folder).collect()}
        assert rows == {x: (int((e[i] > 0).sum()), pytest.approx(e[i].sum(), abs=1e-6)) for i, x in enumerate(types)}
