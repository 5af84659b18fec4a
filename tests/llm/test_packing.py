import hashlib
import random

import pytest

from spanloom.llm import bpe, packing
from tests.llm.helpers import clashing, docs, odd


def brute(rows, capacity, shard_docs):
    """{(shard, bin_class, bin_no): [(doc_id, piece, words)]}, by definition."""
    shards = max(1, -(-len(rows) // shard_docs))
    places, out = {}, {}
    for d, t in sorted(rows):
        words = (t or "").split()
        for piece in range(-(-len(words) // capacity)):
            part = words[piece * capacity : (piece + 1) * capacity]
            key = (int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) % shards, capacity // len(part))
            at = places[key] = places.get(key, -1) + 1
            out.setdefault((*key, at // key[1]), []).append((d, piece, part))
    return out


def as_brute(rows):
    """The same of packed rows; that the text is what its boundaries say is checked on the way."""
    out = {}
    for r in rows:
        parts = [p.split(" ") for p in r.text.split(packing.SEPARATOR)]
        assert [len(p) for p in parts] == r.lengths and sum(r.lengths) == r.n_units
        out[(r.shard, r.bin_class, r.bin_no)] = list(zip(r.doc_ids, r.pieces, parts, strict=True))
    assert len(out) == len(rows)
    return out


def test_brute_force(spark):
    r = random.Random(4)
    rows = [(i, " \n".join(f"w{r.randrange(50)}" for _ in range(r.choice([0, 1, 2, 5, 9, 10, 11, 33, 100])))) for i in range(200)]
    for shard in (1000, 37):
        got = as_brute(packing.pack(docs(spark, rows), capacity=32, shard_docs=shard).collect())
        assert got == brute(rows, 32, shard)
    assert all(sum(len(p) for _, _, p in b) <= 32 for b in got.values())
    # every class of a shard leaves at most one bin open
    short = [k[:2] for k, b in got.items() if len(b) < k[1]]
    assert len(short) == len(set(short))


def test_token_ids(spark):
    """The ids that op2 gives are packed whole and in order, and can be read back."""
    rows = [(i, " ".join(f"word{k}" for k in range(3 * i + 1))) for i in range(40)]
    ids = {r.doc_id: r.ids for r in bpe.encode(docs(spark, rows)).collect()}
    got = packing.pack_arrays(bpe.encode(docs(spark, rows)), "ids", capacity=100).collect()
    back = {}
    for r in got:
        assert len(r.units) == r.n_units == sum(r.lengths) <= 100
        at = 0
        for d, piece, n in zip(r.doc_ids, r.pieces, r.lengths, strict=True):
            back.setdefault(d, {})[piece] = r.units[at : at + n]
            at += n
    assert {d: [x for k in sorted(ps) for x in ps[k]] for d, ps in back.items()} == ids


def test_odd_rows(spark):
    df = clashing(odd(spark))
    got = packing.pack(df, capacity=100).collect()
    by = {}
    for r in got:
        for d, n in zip(r.doc_ids, r.lengths, strict=True):
            by[d] = by.get(d, 0) + n
    assert by == {None: 3, 4: 60_000, 5: 4, 6: 2, 7: 1}
    assert packing.pack(df.limit(0)).count() == 0
    for bad in ({"capacity": 0}, {"shard_docs": 0}):
        with pytest.raises(ValueError, match="positive"):
            packing.pack(df, **bad)
    arrays = spark.createDataFrame([(1, [1, None]), (2, None), (3, []), (None, [5])], "doc_id long, ids array<int>")
    got = {r.bin_class: (r.doc_ids, r.units) for r in packing.pack_arrays(arrays, "ids", capacity=2).collect()}
    assert got == {1: ([1], [1, None]), 2: ([None], [5])}
