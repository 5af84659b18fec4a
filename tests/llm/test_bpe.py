import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import bpe
from tests.llm.helpers import clashing, odd


@pytest.fixture(scope="module")
def theirs():
    b = bpe.load()
    return tiktoken.Encoding("check", pat_str=bpe.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_whole_corpus_round_trip_and_ids(spark, data, theirs):
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode(df, check=True).collect()}
    for r in df.collect():
        assert got[r.doc_id].round_trip and got[r.doc_id].ids == theirs.encode_ordinary(r.text) and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {r.doc_id: r.text for r in df.collect()}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_against_another_encoder(text):
    b = bpe.load()
    enc = tiktoken.Encoding("check", pat_str=bpe.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    ids, off = b.encode_many([text])
    assert ids.tolist() == enc.encode_ordinary(text)
    out, back = b.decode_many(ids, off)
    assert bytes(out).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merge_by_definition(piece):
    """Merge the leftmost pair of the lowest rank until none is left."""
    b = bpe.load()
    parts = [bytes([x]) for x in piece]
    while len(parts) > 1:
        ranked = [(b.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in b.ranks]
        if not ranked:
            break
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert b.merge(piece) == [b.ranks[x] for x in parts]


def test_odd_rows(spark):
    df = odd(spark)
    got = bpe.encode(clashing(df), check=True).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert by[1].ids == [] and by[1].n_tokens == 0 and by[2].ids is None and by[2].round_trip is None
    assert all(r.round_trip for r in got if r.doc_id != 2)
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert texts == {r.doc_id: r.text for r in df.collect()}
    assert bpe.encode(df.limit(0)).count() == 0 and bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_bad_ids():
    b = bpe.load()
    for bad in (-1, len(b.lens)):
        with pytest.raises(ValueError):
            b.decode_many(np.array([bad]), np.array([0, 1]))


def test_broken_bytes(spark):
    b = bpe.load()
    half = [b.ranks["é".encode()[:1]]]
    got = bpe.decode(spark.createDataFrame([(1, half), (2, None), (3, [])], "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.text for r in got} == {1: "�", 2: None, 3: ""}


def test_long_piece():
    b = bpe.load()
    ids = b.merge(b"ab" * 100_000)
    assert b"".join(bytes(b.bytes[b.starts[i] : b.starts[i] + b.lens[i]]) for i in ids) == b"ab" * 100_000
