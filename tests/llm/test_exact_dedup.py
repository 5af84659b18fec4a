import pytest

from spanloom.llm import exact_dedup as x
from tests.llm.helpers import clashing, docs, odd


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    first = {}
    for d, t in sorted(rows):
        first.setdefault(t, d)
    got = {(r.doc_id, r.first_doc_id, r.copy) for r in x.find_copies(df).collect()}
    assert got == {(d, first[t], d != first[t]) for d, t in rows}
    assert ids(x.dedup(df)) == sorted(first.values())
    assert got == {tuple(r) for r in x.query(spark, data).collect()}


def test_index_over_batches(spark, tmp_path):
    index = x.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    assert ids(x.dedup(docs(spark, [(1, "a"), (2, "b"), (3, "a")]), index=index)) == [1, 2]
    # the next session finds the folder again
    spark.sql(f"DROP TABLE {index.name}")
    index = x.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    batch = docs(spark, [(4, "b"), (5, "c"), (6, "c"), (7, None)])
    found = {r.doc_id: (r.first_doc_id, r.copy) for r in x.find_copies(batch, index=index).collect()}
    assert found == {4: (2, True), 5: (5, False), 6: (5, True), 7: (7, False)}
    assert ids(x.dedup(batch, index=index)) == [5, 7]
    assert ids(x.dedup(batch, index=index)) == [7]
    assert index.read().count() == 3
    plan = x._winners(x._pairs(batch.selectExpr("doc_id", "unhex(sha2(text, 256)) AS digest"))).join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_any_session_setting_reads_the_index(spark, tmp_path):
    """Registered again under other shuffle partitions, every known text is still found."""
    path, was = f"file://{tmp_path}/index", spark.conf.get("spark.sql.shuffle.partitions")
    known = docs(spark, [(i, f"text {i}") for i in range(200)])
    again = docs(spark, [(1000 + i, f"text {i}") for i in range(220)])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        x.absorb(known, x.DigestIndex(spark, path))
        for n in ("4", "16", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            index = x.DigestIndex(spark, path)
            assert index.buckets == 8
            found = {r.doc_id: r.first_doc_id for r in x.find_copies(again, index=index).collect() if r.copy}
            assert found == {1000 + i: i for i in range(200)}
        x.absorb(again, index)
        assert index.read().count() == 220
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    with pytest.raises(ValueError, match="8 buckets"):
        x.DigestIndex(spark, path, 16)
    with pytest.raises(ValueError, match="positive"):
        x.DigestIndex(spark, f"{path}2", 0)


def test_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = x.DigestIndex(spark, path, 4)
    for lo in range(0, 60, 20):
        x.absorb(docs(spark, [(i, f"text {i % 50}") for i in range(lo, lo + 20)]), index)
    want = {(bytes(r.digest), r.doc_id) for r in index.read().collect()}
    assert len(want) == 50 and len(index.read().inputFiles()) > 4
    index.compact()
    assert len(index.read().inputFiles()) <= 4 and {(bytes(r.digest), r.doc_id) for r in index.read().collect()} == want
    x.absorb(docs(spark, [(100, "text 3"), (101, "new")]), index)
    index.close()
    index = x.DigestIndex(spark, path)
    assert index.version == 1 and index.read().count() == 51
    assert ids(x.dedup(docs(spark, [(200, "text 49"), (201, "other")]), index=index)) == [201]


def test_arrivals(spark):
    rows = [(i, "a") for i in (5, 1, 9, None)] + [(1, "b")]
    first, second = x.arrivals(docs(spark, rows))
    assert sorted(r.doc_id for r in first.collect()) == [1, 1, 5] and {r.doc_id for r in second.collect()} == {9, None}
    assert len(x.arrivals(docs(spark, [(None, "a")]))) == 1 and len(x.arrivals(docs(spark, []))) == 1


def test_odd_rows(spark):
    df = clashing(odd(spark).unionByName(docs(spark, [(20, ""), (None, "same row"), (None, "lost words here"), (None, "only null id")])))
    kept = x.dedup(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect() if r.doc_id not in (4, 7)), key=lambda g: (g[0], g[1] or ""))
    assert got == [(-1, "lost words here"), (-1, "only null id"), (1, ""), (2, None), (3, "   \n\t "), (5, "same row"), (6, "é\U0001f600\x00 ünï"), (8, "\n\n\n")]
    assert x.dedup(df.limit(0)).count() == 0 and x.find_copies(df.limit(0)).count() == 0
    nulls = docs(spark, [(1, None), (1, None)])
    assert x.dedup(nulls).count() == 2
