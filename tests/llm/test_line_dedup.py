import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.line_dedup import _without, dedup_lines, fingerprints, lines, window_table, windows, winnow
from tests.llm.helpers import clashing, docs, odd


def brute(rows, least):
    """Delete every line of a repeated run of least words or more that occurred earlier, by definition."""
    split = {d: t.split("\n") for d, t in rows}
    count = {d: [len(x.replace("\t", " ").replace("\r", " ").split(" ")) - x.replace("\t", " ").replace("\r", " ").split(" ").count("") for x in ls] for d, ls in split.items()}
    first, gone = {}, {d: set() for d in split}
    for d in sorted(split):
        ls = split[d]
        for s in range(len(ls)):
            for e in range(s, len(ls)):
                if sum(count[d][s : e + 1]) >= least:
                    first.setdefault(tuple(ls[s : e + 1]), (d, s))
    for d, ls in split.items():
        for s in range(len(ls)):
            for e in range(s, len(ls)):
                if sum(count[d][s : e + 1]) >= least and first[tuple(ls[s : e + 1])] < (d, s):
                    gone[d] |= set(range(s, e + 1))
    return {d: ("\n".join(x for i, x in enumerate(ls) if i not in gone[d]), len(gone[d])) for d, ls in split.items()}


def table(seed, n):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcde") for _ in range(r.randrange(1, 6))) for _ in range(25)] + [""]
    return [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for i in range(n)]


def test_brute_force(spark):
    for seed in range(3):
        rows = table(seed, 60)
        got = {r.doc_id: (r.text, r.lines_removed) for r in dedup_lines(docs(spark, rows), min_words=7).collect()}
        assert got == brute(rows, 7)


def test_passage_of_fifty_words(spark):
    passage = "\n".join(" ".join(f"p{k}w{i}" for i in range(13)) for k in range(4))
    rows = [(1, "head one\n" + passage + "\ntail one"), (2, "head two\n" + passage + "\ntail two"), (3, "alone")]
    got = {r.doc_id: r.text for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "head two\ntail two", 3: "alone"}


def test_winnowing_leaves_few_windows(spark, data):
    """Only windows with a fingerprint that is met again are joined: fewer than there are lines."""
    df = spark.read.parquet(f"{data}/documents.parquet")
    again = fingerprints(df, "doc_id", "text", 50)
    left = window_table(df, "doc_id", "text", 50).join(again, "fp", "left_semi").count()
    n_lines = sum(r.text.count("\n") + 1 for r in df.collect() if r.text is not None)
    assert 0 < left < n_lines / 2


def test_one_id_with_several_texts(spark):
    passage = "\n".join(" ".join(f"q{k}w{i}" for i in range(26)) for k in range(2))
    rows = [(1, "one\n" + passage), (1, passage + "\ntwo"), (1, passage + "\ntwo"), (2, passage)]
    got = [(r.doc_id, r.text, r.lines_removed) for r in dedup_lines(docs(spark, rows)).collect()]
    # one of the two texts of id 1 comes first, the rows of the other are alike
    assert sorted(n for d, _, n in got if d == 1) in ([0, 2, 2], [0, 0, 2]) and (2, "", 2) in got


def test_many_copies(spark):
    text = "\n".join(" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    got = dedup_lines(docs(spark, [(i, text) for i in range(300)])).collect()
    assert sum(r.text == text for r in got) == 1 and sum(r.text == "" for r in got) == 299


def test_odd_rows(spark):
    df = odd(spark)
    got = dedup_lines(clashing(df)).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert by[1].text == "" and by[2].text is None and by[None].text == "lost words here"
    assert all(r.lines_removed == 0 for r in got)
    assert dedup_lines(df.limit(0)).count() == 0


def test_clashing_count_column(spark):
    from pyspark.sql import functions as F

    got = dedup_lines(docs(spark, [(1, "a")]).withColumn("lines_removed", F.lit("mine"))).first()
    assert got.lines_removed == "mine" and got["_lines_removed"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="a b\nc", max_size=30), min_size=1, max_size=4), st.integers(1, 6))
def test_windows(texts, least):
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    doc, h, words = lines(np.frombuffer(b"".join(data), np.uint8), off)
    want = [(i, len(x.split())) for i, t in enumerate(texts) for x in t.split("\n")]
    assert list(zip(doc.tolist(), words.tolist(), strict=True)) == want
    s, e, fp, content = windows(doc, h, words, least)
    flat = [x for t in texts for x in t.split("\n")]
    seen = {}
    for a, b, f, c in zip(s, e, fp, content, strict=True):
        shortest = next(k for k in range(a, b + 1) if words[a : k + 1].sum() >= least)
        assert doc[a] == doc[b] and words[a : b + 1].sum() >= least and f == h[a : shortest + 1].min()
        assert seen.setdefault(int(c), flat[a : b + 1]) == flat[a : b + 1]
        # nothing shorter would do at one of its ends
        assert words[a:b].sum() < least or words[a + 1 : b + 1].sum() < least
    picked = set()
    for a in range(len(h)):
        for b in range(a, len(h)):
            if doc[a] == doc[b] and words[a : b + 1].sum() >= least:
                picked.add(max(k for k in range(a, b + 1) if h[k] == h[a : b + 1].min()))
                break
    assert winnow(doc, h, words, least).tolist() == sorted(picked)


def test_without(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\nc\nd", [(0, 0), (2, 2)]), ("a\nb", [(0, 1)]), ("a\nb\n", [(1, 1)])], "t string, r array<struct<s:int,e:int>>")
    assert [r[0] for r in df.select(_without(F.col("t"), F.col("r"))).collect()] == ["b\nd", "", "a\n"]
