"""N-gram Jaccard join by parity sketches.

All pairs of documents whose sets of word n-grams have a Jaccard similarity of at least tau.

A set's elements are hashed into the P parts of a sketch; a part holds the parity (XOR) of
its elements' hashes. One element more or less changes one part only, so the number of
differing parts is a lower bound of the symmetric difference, and two sets that differ in
few elements must agree in some part. Each part becomes a join key per size band, the
sizes of a band lying within a factor of three; a set near the top of its band is a guest
in the next one, since partners are at most 1/tau times as large. All elements of a set
take part, whatever its size.

The pigeonhole bound asks for D + 1 parts, which at tau = 0.6 is one part for two elements:
most parts would be one frequent n-gram, and all sets that have it would meet. Here a part is
a key from 3 elements on, or more in bands of large sets. P, that number and the number of
independent partitionings are those for which a pair exactly at tau agrees in AGREE such parts
on average, at every size of the band, with the fewest keys and chance meetings of sets that
are a quarter alike. By the Poisson law a pair at tau meets nowhere with probability
exp(-AGREE) < 0.001, and one at 0.7 with less than 1e-6. Sets of up to SMALL elements are joined exactly, on
all combinations of as many elements as a pair must share, three at most.

Groups stand for their sets in the join, as a group of m near copies has m * m pairs in most
of its keys. A set's group is the least set of a key (its hub) with which it shares the most
keys, two at least, or its own. Two groups that have a key in common are compared, all sets of
the one with all of the other, and so is each group with itself: whatever the groups are, no
pair that shares a key is left out, and no pair is met twice.

Comparisons are in full: groups are cut into pieces, pairs of pieces into tiles, and each set
travels once to each tile that needs it. In small pairs of pieces a 4096-bit parity sketch
rejects two sets when its Hamming distance is beyond the symmetric difference that tau allows,
and the rest are intersected. In large ones all intersections are counted at once: common
elements by a matrix product, rare ones by their places. A tile gives each set's number of
links and edges enough to connect what its links connect, not the links one by one.

Sets that are equal are one entity: its lowest doc_id stands for it in the join. ``classes``
gives a row per document with its class (the lowest doc_id that near pairs and copies lead
to), its links (all other sets at tau or more) and its copies, so a thousand copies give a
thousand rows; ``near_pairs`` gives the pairs of sets, and each copy with its lowest id.

``dedup`` needs the classes alone. A key's sets are first compared with the least of them
only; then with each other where these comparisons left them in different classes. A group of
near copies so takes a row each and not all its pairs, and no link between classes is lost.

Defined results
- Words are those of ``bytesvec`` in the lower-cased text; a text of fewer than n words is
  one gram of all its words. A null, empty or wordless text has no pairs.
- Rows with a null doc_id take no part. Rows equal in doc_id and set are one document; rows
  of one doc_id with different sets are compared and have a row each in ``classes``, but no
  document is paired with itself.
- An empty table gives no pairs. Other columns are ignored, whatever their names.
- There is no cap on partners or candidates; every pair that is given is right, up to 40-bit
  hash collisions of n-grams.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import bytesvec
from spanloom.llm.common import fresh, map_batches, named_apart, quoted, ship, slices, text_bytes
from spanloom.llm.components import components
from spanloom.plans.session import BROADCAST_BYTES, data_bytes, drop_scratch, materialize, small_or_plain

N, TAU = 2, 0.6
SMALL = 8
#: Parts in which a pair exactly at tau agrees on average; similarity of the pairs that should not meet.
AGREE, UNLIKE = 7.0, 0.25
TILE_PAIRS = 50_000
#: Sets of a piece of a group, and their elements; pairs of sets from which two pieces are compared by matrices.
PIECE_SETS, PIECE_ELEMENTS, MATRIX_PAIRS = 2048, 1_000_000, 256
SKETCH_BITS = 4096
#: Bytes of text or elements that one numpy pass works on, at about a hundred bytes of memory each.
PASS_BYTES = 700_000
_WIDTH = 5  # bytes of an element


def _poisson_tail(lam: float, m: int) -> float:
    return 1 - sum(math.exp(-lam) * lam**k / math.factorial(k) for k in range(m))


def _meetings(parts: int, n: float, j: float, telling: int) -> float:
    """Telling parts in which two sets of n elements and similarity j agree, on average."""
    return parts * math.exp(-2 * (1 - j) / (1 + j) * n / parts) * _poisson_tail(2 * j / (1 + j) * n / parts, telling)


@cache
def band_plan(band: int, tau: float) -> tuple[int, int, int]:
    """(parts, partitionings, elements of a telling part) of the sets with 9 * 3**band elements and up.

    A chance meeting costs as much as some keys, as the sets then travel to be verified.
    """
    low, top = (SMALL + 1) * 3.0**band, (SMALL + 1) * 3.0 ** (band + 1)
    mid = math.sqrt(low * top)
    best = (math.inf, 0, 0, 0)
    for telling in range(3, 8):
        parts = 2
        while parts < top:
            f = min(_meetings(parts, n, tau, telling) for n in (low, mid, top))
            if f > 1e-4:
                repeats = math.ceil(AGREE / f)
                keys = parts * _poisson_tail(mid / parts, telling)
                chance = max(_meetings(parts, n, UNLIKE * tau / TAU, telling) for n in (low, mid, top))
                best = min(best, (repeats * (keys + max(50, mid / 20) * chance), parts, repeats, telling))
            parts = max(parts + 1, parts * 51 // 50)
    return best[1:]


def _band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n / (SMALL + 1)) / math.log(3) + 1e-9).astype(np.int64)


@cache
def shared_counts(n: int, tau: float) -> tuple[int, ...]:
    """How many elements, three at most, the combinations of a set of n must have to meet all partners of small pairs."""
    out = set()
    for m in range(max(1, math.ceil(tau * n - 1e-9)), math.floor(n / tau + 1e-9) + 1):
        if min(n, m) <= SMALL:
            need = math.ceil(tau / (1 + tau) * (n + m) - 1e-9)
            if need <= min(n, m):
                out.add(min(3, need))
    return tuple(sorted(out))


def _elements(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(40-bit elements sorted within each document, elements of each document)."""
    starts, ends, doc = bytesvec.words(data, offsets)
    g, gd = bytesvec.ngram_hashes(bytesvec.word_hashes(data, starts, ends), doc, len(offsets) - 1, n)
    tag = (gd.astype(np.uint64) << np.uint64(40)) | (g >> np.uint64(24))
    tag.sort()
    if len(tag):
        tag = tag[np.concatenate([[True], tag[1:] != tag[:-1]])]
    counts = np.bincount((tag >> np.uint64(40)).astype(np.int64), minlength=len(offsets) - 1)
    return tag & np.uint64((1 << 40) - 1), counts


def _pack(e: np.ndarray) -> np.ndarray:
    return e.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH].ravel()


def _unpack(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // _WIDTH, 8), np.uint8)
    out[:, :_WIDTH] = b.reshape(-1, _WIDTH)
    return out.view("<u8").ravel()


def _signature(e: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set; 0 for an empty one."""
    sig = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        first = (np.cumsum(counts) - counts)[some]
        sig[some] = bytesvec.mix(np.bitwise_xor.reduceat(bytesvec.mix(e), first) + np.add.reduceat(bytesvec.mix(e + np.uint64(1 << 41)), first) * np.uint64(3) + counts[some].astype(np.uint64))
    return sig.view(np.int64)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, elements: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, th, n, sig[, elements]) of every document with an id and words; th is the text's hash. only: (only_id) of those wanted.

    The elements are larger than the compressed text, so they are computed anew where they
    are needed and never written.
    """
    ship(docs.sparkSession)
    kinds = "doc_id long, th long, n int, sig long" + (", elements binary" if elements else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2), PASS_BYTES):
                part = b.slice(lo, hi - lo)
                e, counts = _elements(*text_bytes(part.column(2)), n)
                cols = [part.column(0), part.column(1), pa.array(counts, pa.int32()), pa.array(_signature(e, counts))]
                if elements:
                    off = np.concatenate([[0], np.cumsum(counts)]) * _WIDTH
                    cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(_pack(e))]))
                out = pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n", "sig", "elements"][: len(cols)])
                yield out.filter(pa.array(counts > 0))

    d = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("th"), F.lower(quoted(text_col)).alias("text"))
    d = d.where("doc_id IS NOT NULL AND text IS NOT NULL")
    if only is not None:
        d = d.join(only, F.col("doc_id") == F.col("only_id"), "left_semi")
    return map_batches(d, run, kinds)


def keys_of(e: np.ndarray, counts: np.ndarray, sig: np.ndarray, tau: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (key, sig, size, negative for a guest)."""
    out = []
    first = np.cumsum(counts) - counts
    hashed = bytesvec.mix(e + np.uint64(0x51ED27))
    regular = np.flatnonzero(counts > SMALL)
    if len(regular):
        own = _band(counts[regular])
        lower = (SMALL + 1) * 3.0 ** (own + 1)
        visits = [(own, regular, False), (own + 1, regular, True)]
        for bands, docs, guest in visits:
            on = counts[docs] >= tau * lower - 1e-9 if guest else np.ones(len(docs), bool)
            for band in np.unique(bands[on]):
                pick = docs[on & (bands == band)]
                parts, repeats, telling = band_plan(int(band), tau)
                k = counts[pick]
                at = np.arange(int(k.sum())) + np.repeat(first[pick] - (np.cumsum(k) - k), k)
                row = np.repeat(np.arange(len(pick)), k)
                h = hashed[at]
                found = []
                for r in range(repeats):
                    place = row * parts + ((bytesvec.mix(h + np.uint64(1000 + r)) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(place, kind="stable")
                    place = place[order]
                    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    size = np.diff(np.append(begin, len(place)))
                    x = np.bitwise_xor.reduceat(h[order], begin)
                    tell = size >= telling
                    p = place[begin[tell]]
                    col = p % parts + r * parts
                    key = bytesvec.mix(x[tell] ^ bytesvec.mix((np.uint64(band) << np.uint64(40)) + col.astype(np.uint64) + np.uint64(1)))
                    found.append((p // parts, key))
                d, key = (np.concatenate(z) for z in zip(*found, strict=True))
                n = counts[pick][d]
                out.append((key, sig[pick][d], -n if guest else n))
    small = np.flatnonzero((counts > 0) & (counts <= math.floor(SMALL / tau + 1e-9)))
    keys, whose = [], []
    for i in small:
        own = [int(v) for v in hashed[first[i] : first[i] + counts[i]]]
        for c in shared_counts(int(counts[i]), tau):
            for combo in itertools.combinations(own, c):
                x = c << 56
                for v in combo:
                    x ^= v
                keys.append(x & (2**64 - 1))
                whose.append(i)
    if keys:
        w = np.array(whose)
        out.append((bytesvec.mix(np.array(keys, np.uint64) ^ np.uint64(0xABCDEF)), sig[w], counts[w]))
    return out


def key_table(sets: DataFrame, tau: float) -> DataFrame:
    """(key, sig, n) of (sig, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1), PASS_BYTES):
                part = b.slice(lo, hi - lo)
                data, off = text_bytes(part.column(1))
                for key, sig, n in keys_of(_unpack(data), np.diff(off) // _WIDTH, part.column(0).to_numpy(), tau):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sig), pa.array(n.astype(np.int32))], names=["key", "sig", "n"])

    return map_batches(sets.select("sig", "elements"), run, "key long, sig long, n int")


def _groups(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meetings: key, sig, n of the keys of several sets; members: sig, label, n, s, m, piece of their sets).

    A group of m sets is that of one label and has s pieces.
    """
    w = Window.partitionBy("key")
    met = keys.select("key", "sig", "n", F.min("sig").over(w).alias("hub"), F.max("sig").over(w).alias("last")).where("hub < last")
    met = materialize(met.select("key", "sig", "n", "hub"), "meetings")
    shared = met.where("sig <> hub").groupBy("sig", "hub").count().where("count > 1")
    led = shared.groupBy("sig").agg(F.max(F.struct("count", F.bitwise_not("hub").alias("least"))).alias("best")).select("sig", F.bitwise_not("best.least").alias("label"))
    own = met.groupBy("sig").agg(F.max(F.abs("n")).alias("n")).join(led, "sig", "left")
    own = materialize(own.select("sig", "n", F.coalesce("label", "sig").alias("label")), "groups")
    s = F.greatest(F.ceil(F.count(F.lit(1)) / PIECE_SETS), F.ceil(F.sum("n") / PIECE_ELEMENTS)).cast("int")
    sizes = own.groupBy("label").agg(s.alias("s"), F.count(F.lit(1)).alias("m"))
    members = own.join(sizes, "label").withColumn("piece", _piece(F.col("label"), F.pmod(F.xxhash64("sig"), "s").cast("int")))
    return met, materialize(members.select("sig", "label", "n", "s", "m", "piece"), "members")


def _piece(label: Column, number: Column) -> Column:
    return F.xxhash64(label, number)


def _units(met: DataFrame, members: DataFrame, tau: float) -> DataFrame:
    """(a, b, work) of the pairs of pieces to compare, a piece with itself included, each once."""
    named = met.join(small_or_plain(members.select("sig", "label")), "sig").repartition("key")
    here = named.groupBy("key", "label").agg(F.min(F.abs("n")).alias("lo"), F.max(F.abs("n")).alias("hi"), F.max("n").alias("own"))
    on = F.expr(f"l.key = r.key AND l.label < r.label AND (l.own > 0 OR r.own > 0) AND l.hi >= {tau}D * r.lo - 1e-9D AND r.hi >= {tau}D * l.lo - 1e-9D")
    pairs = here.alias("l").join(here.alias("r"), on).select(F.col("l.label").alias("la"), F.col("r.label").alias("lb")).distinct()
    sizes = members.select("label", "s", "m").distinct()
    pairs = pairs.union(sizes.where("m > 1").select("label", "label"))
    sizes = small_or_plain(materialize(sizes, "group-sizes"))
    both = pairs.join(sizes.toDF("la", "sa", "ma"), "la").join(sizes.toDF("lb", "sb", "mb"), "lb")
    both = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sa") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)))
    work = F.col("ma") / F.col("sa") * F.col("mb") / F.col("sb")
    return both.where("la <> lb OR i <= j").select(_piece(F.col("la"), F.col("i")).alias("a"), _piece(F.col("lb"), F.col("j")).alias("b"), work.alias("work"))


def _tiles(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(tile, a, b) of pairs (a, b, work): near pairs share a block; a block of much work is cut into square tiles."""
    low = small_or_plain(vertices.select("v", "low"))
    p = pairs.join(low.select(F.col("v").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("v").alias("b"), F.col("low").alias("lb")), "b")
    p = p.select("a", "b", "work", F.least("la", "lb").alias("block"))
    big = p.groupBy("block").agg(F.sum("work").alias("work")).where(F.col("work") > TILE_PAIRS).select("block", F.ceil(F.sqrt(F.col("work") / TILE_PAIRS)).cast("int").alias("s"))
    p = p.join(small_or_plain(materialize(big, "large-blocks")), "block", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    return p.select(F.xxhash64("block", F.pmod(F.xxhash64("a"), F.col("s")), F.pmod(F.xxhash64("b"), F.col("s"))).alias("tile"), "a", "b")


def _parity(e: np.ndarray) -> np.ndarray:
    bits = np.bincount((bytesvec.mix(e + np.uint64(5)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _near(sets: dict, pairs: list[tuple[int, int]], tau: float) -> list[tuple[int, int, float]]:
    """(a, b, jaccard) of the pairs at tau or more."""
    out = []
    if not pairs:
        return out
    sketch = {}
    for s, e in sets.items():
        sketch[s] = _parity(e)
    for k in range(0, len(pairs), 4096):
        some = pairs[k : k + 4096]
        x = np.stack([sketch[a] for a, _ in some]) ^ np.stack([sketch[b] for _, b in some])
        ham = np.bitwise_count(x).sum(1)
        total = np.array([len(sets[a]) + len(sets[b]) for a, b in some])
        for i in np.flatnonzero(ham <= (1 - tau) / (1 + tau) * total + 1e-9):
            a, b = some[i]
            merged = np.concatenate([sets[a], sets[b]])
            merged.sort(kind="stable")
            both = int((merged[1:] == merged[:-1]).sum())
            j = both / (total[i] - both)
            if j >= tau - 1e-12:
                out.append((a, b, j))
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left has in common with each of right."""
    m, k = len(left), len(right)
    sides = []
    for side in (left, right):
        e, row = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        order = np.argsort(e, kind="stable")
        sides.append((e[order], row[order]))
    both = np.intersect1d(*(np.unique(e) for e, _ in sides), assume_unique=True)
    (el, rl), (er, rr) = sides
    fl, fr = (np.searchsorted(e, both, "right") - np.searchsorted(e, both) for e in (el, er))
    rl, rr = rl[np.isin(el, both)], rr[np.isin(er, both)]
    bl, br = np.cumsum(fl) - fl, np.cumsum(fr) - fr
    out = np.zeros((m, k), np.float32)

    def entries(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)

    # an element is worth a column of a product when more than a hundredth of the pairs have it
    dense = np.flatnonzero(fl * fr * 100 > m * k)
    for at in range(0, len(dense), 1024):
        c = dense[at : at + 1024]
        x, y = np.zeros((m, len(c)), np.float32), np.zeros((k, len(c)), np.float32)
        x[rl[entries(bl[c], fl[c])], np.repeat(np.arange(len(c)), fl[c])] = 1
        y[rr[entries(br[c], fr[c])], np.repeat(np.arange(len(c)), fr[c])] = 1
        out += x @ y.T
    rare = np.flatnonzero(fl * fr * 100 <= m * k)
    row = rl[entries(bl[rare], fl[rare])]
    begin, many = np.repeat(br[rare], fl[rare]), np.repeat(fr[rare], fl[rare])
    done, total = 0, np.cumsum(many)
    while done < len(row):
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 1_000_000, "right")))
        part = slice(done, end)
        place = np.repeat(row[part], many[part]) * k + rr[entries(begin[part], many[part])]
        out += np.bincount(place, minlength=m * k).reshape(m, k)
        done = end
    return out


def _alike(left: list[np.ndarray], right: list[np.ndarray], tau: float) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs are at tau or more, what they have in common)."""
    common = _common(left, right)
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    near = np.zeros(common.shape, bool)
    for k in range(0, len(left), 128):
        c = common[k : k + 128].astype(np.float64)
        near[k : k + 128] = c / (nl[k : k + 128, None] + nr - c) >= tau - 1e-12
    return near, common


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(root row, row) and (root row, column) that connect the rows and columns that near connects."""
    m, k = near.shape
    row_root, col_root = np.full(m, -1), np.full(k, -1)
    for i in np.flatnonzero(near.any(1)):
        if row_root[i] >= 0:
            continue
        rows = np.array([i])
        while len(rows):
            row_root[rows] = i
            cols = np.flatnonzero(near[rows].any(0) & (col_root < 0))
            col_root[cols] = i
            rows = np.flatnonzero(near[:, cols].any(1) & (row_root < 0)) if len(cols) else cols
    r, c = np.flatnonzero(row_root >= 0), np.flatnonzero(col_root >= 0)
    return row_root[r], r, col_root[c], c


def _compare(tau: float, every: bool):
    """Tiles of pieces to (a, b, jaccard) of every link; else to (a, links) and (a, b), edges that connect what links do.

    Two sets of one lowest doc_id are no link.
    """
    names = ["a", "b", "jaccard" if every else "links"]

    def batch(a, b, x) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(x, pa.float64() if every else pa.int64())], names=names)

    def by_pairs(sets: dict, first: dict, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = [(a, b) for a, b in pairs if first[a] != first[b]]
        found = _near({x: sets[x] for x in {*itertools.chain(*pairs)}}, pairs, tau)
        a, b, x = zip(*found, strict=True) if found else ((), (), ())
        if every:
            return batch(a, b, x)
        links = Counter(a) + Counter(b)
        return batch([*a, *links], [*b, *[None] * len(links)], [*[None] * len(a), *links.values()])

    def by_matrix(sets: dict, first: dict, l: list[int], r: list[int]) -> pa.RecordBatch:  # noqa: E741
        near, common = _alike([sets[x] for x in l], [sets[x] for x in r], tau)
        near &= np.array([first[x] for x in l])[:, None] != np.array([first[x] for x in r])
        a, b = np.array(l), np.array(r)
        if every:
            i, j = np.nonzero(np.triu(near, 1) if l is r else near)
            c = common[i, j].astype(np.float64)
            n = np.array([len(sets[x]) for x in l])[i] + np.array([len(sets[x]) for x in r])[j]
            return batch(a[i], b[j], c / (n - c))
        rr, i, rc, j = _forest(near)
        edges = np.concatenate([a[rr], a[rc]]), np.concatenate([a[i], b[j]])
        sides = [(a, near.sum(1))] + [(b, near.sum(0))] * (l is not r)
        own, links = (np.concatenate(z) for z in zip(*sides, strict=True))
        own, links = own[links > 0], links[links > 0]
        return batch([*edges[0].tolist(), *own.tolist()], [*edges[1].tolist(), *[None] * len(own)], [*[None] * len(edges[0]), *links.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, first, pieces, units = None, {}, {}, defaultdict(list), []

        def results() -> Iterator[pa.RecordBatch]:
            pairs = []
            for u, v in units:
                l, r = pieces[u], pieces[v]  # noqa: E741
                if len(l) * len(r) > MATRIX_PAIRS:
                    yield by_matrix(sets, first, l, r)
                else:
                    pairs += itertools.combinations(l, 2) if u == v else itertools.product(l, r)
                if len(pairs) >= TILE_PAIRS:
                    yield by_pairs(sets, first, pairs)
                    pairs = []
            yield by_pairs(sets, first, pairs)

        for b in batches:
            tile, u, v, sig, doc = (b.column(i).to_pylist() for i in range(5))
            elements = b.column(5)
            for i, t in enumerate(tile):
                if t != at:
                    if units:
                        yield from results()
                    at, sets, first, pieces, units = t, {}, {}, defaultdict(list), []
                if v[i] is not None:
                    units.append((u[i], v[i]))
                elif sig[i] not in sets:
                    sets[sig[i]] = _unpack(np.frombuffer(elements[i].as_buffer(), np.uint8))
                    first[sig[i]] = doc[i]
                    pieces[u[i]].append(sig[i])
        if units:
            yield from results()

    return run


def _verify(tau: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, pairs = None, {}, []

        def result() -> pa.RecordBatch:
            found = _near(sets, pairs, tau)
            a, b, j = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j, pa.float64())], names=["a", "b", "jaccard"])

        for batch in batches:
            tile, a, b = (batch.column(i).to_pylist() for i in range(3))
            elements = batch.column(3)
            for i, t in enumerate(tile):
                if t != at:
                    if pairs:
                        yield result()
                    at, sets, pairs = t, {}, []
                if b[i] is None:
                    sets[a[i]] = _unpack(np.frombuffer(elements[i].as_buffer(), np.uint8))
                else:
                    pairs.append((a[i], b[i]))
        if pairs:
            yield result()

    return run


def _sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame, Callable[..., DataFrame]]:
    """(features, (sig, first, copies) of each set, (sig, doc_id, elements) of it from one document only, or of the ids in a table (only_id))."""
    features = materialize(feature_table(docs, id_col, text_col, n), "features")
    own = features.select("sig", "doc_id").distinct()
    reps = materialize(own.groupBy("sig").agg(F.min("doc_id").alias("first"), (F.count(F.lit(1)) - 1).alias("copies")), "sets")
    spare = features.select("sig", "doc_id").join(reps.where("copies > 0").select("sig", "first"), "sig").where("doc_id <> first").select(F.col("sig").alias("s_sig"), F.col("doc_id").alias("s_doc")).distinct()
    spare = materialize(spare, "spare-copies")

    def once(only: DataFrame | None = None) -> DataFrame:
        full = feature_table(docs, id_col, text_col, n, True, only).select("sig", "doc_id", "elements")
        return full.join(small_or_plain(spare), (F.col("sig") == F.col("s_sig")) & (F.col("doc_id") == F.col("s_doc")), "left_anti")

    return features, reps, once


def _compared(once: Callable[..., DataFrame], reps: DataFrame, tau: float, every: bool) -> DataFrame:
    """What ``_compare`` gives of all sets that share a key."""
    met, members = _groups(key_table(once(), tau))
    units = materialize(_units(met, members, tau), "units")
    drop_scratch(members.sparkSession, met)
    both = units.select(F.col("a").alias("v"), F.col("b").alias("u")).union(units.select(F.col("b").alias("v"), F.col("a").alias("u")))
    vertices = materialize(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("low")), "vertices")
    tiles = materialize(_tiles(units, vertices), "tiles")
    need = tiles.select("tile", F.col("a").alias("piece")).union(tiles.select("tile", F.col("b"))).distinct()
    pieces = members.select(F.col("sig").alias("n_sig"), "piece").join(need.select("piece").distinct(), "piece", "left_semi")
    pieces = materialize(pieces, "needed-sets")
    ids = materialize(reps.join(pieces, F.col("sig") == F.col("n_sig"), "left_semi").select(F.col("first").alias("only_id")).distinct(), "needed-ids")
    # a shuffle of all texts would cost more than words found in vain
    left = once(F.broadcast(ids) if data_bytes(ids) <= BROADCAST_BYTES else None)
    left = left.join(small_or_plain(pieces), F.col("sig") == F.col("n_sig")).join(small_or_plain(materialize(need, "needed")), "piece")
    rows = left.select("tile", F.col("piece").alias("a"), F.lit(None).cast("long").alias("b"), "sig", "doc_id", "elements")
    none = F.lit(None)
    rows = rows.union(tiles.select("tile", "a", "b", none.cast("long"), none.cast("long"), none.cast("binary")))
    rows = rows.repartition("tile").sortWithinPartitions("tile", F.col("b").asc_nulls_first())
    return materialize(map_batches(rows, _compare(tau, every), f"a long, b long, {'jaccard double' if every else 'links long'}"), "near-sets")


def _verified(once: DataFrame, cand: DataFrame, tau: float) -> DataFrame:
    """(a, b, jaccard) of the candidates at tau or more."""
    both = cand.select(F.col("a").alias("v"), F.col("b").alias("u")).union(cand.select(F.col("b").alias("v"), F.col("a").alias("u")))
    vertices = materialize(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("low")), "vertices")
    tiles = materialize(_tiles(cand.withColumn("work", F.lit(1)), vertices), "tiles")
    need = tiles.select("tile", F.col("a").alias("n_sig")).union(tiles.select("tile", F.col("b"))).distinct()
    need = materialize(need, "needed")
    left = once.join(small_or_plain(need), F.col("sig") == F.col("n_sig")).select("tile", F.col("sig").alias("a"), F.lit(None).cast("long").alias("b"), "elements")
    rows = left.union(tiles.select("tile", "a", "b", F.lit(None).cast("binary").alias("elements")))
    rows = rows.repartition("tile").sortWithinPartitions("tile", F.col("b").asc_nulls_first())
    return materialize(map_batches(rows, _verify(tau), "a long, b long, jaccard double"), "near-sets")


def _linked(near: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, jaccard, x, y): near sets with the lowest ids of each, unless one document has both."""
    ends = near.select(F.col("a").alias("sig")).union(near.select("b")).distinct()
    name = materialize(reps.join(ends, "sig", "left_semi").select("sig", "first"), "names")
    name = small_or_plain(name)
    x = name.select(F.col("sig").alias("a"), F.col("first").alias("x"))
    y = name.select(F.col("sig").alias("b"), F.col("first").alias("y"))
    return near.join(x, "a").join(y, "b").where("x <> y").select("a", "b", "jaccard", "x", "y")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, tau: float = TAU) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: near sets by their lowest ids, copies with the lowest id of theirs."""
    features, reps, once = _sets(docs, id_col, text_col, n)
    near = _compared(once, reps, tau, True)
    across = _linked(near, reps).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))
    copies = features.select("sig", "doc_id").join(reps.where("copies > 0").select("sig", "first"), "sig").where("doc_id <> first").select(F.col("first").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    # only repeated ids with different sets can give a pair twice
    return across.union(copies.distinct())


def _members(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, first, copies, class_id) of the sets; class_id is the lowest id that links (a, b) lead to."""
    roots = components(links.select("a", "b"))
    named = roots.join(reps.select(F.col("sig").alias("v"), "first"), "v")
    low = named.groupBy("root").agg(F.min("first").alias("class_id"))
    linked = materialize(roots.join(low, "root").select(F.col("v").alias("sig"), "class_id"), "classes")
    return reps.join(linked, "sig", "left").select("sig", "first", "copies", F.coalesce("class_id", "first").alias("class_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, tau: float = TAU) -> DataFrame:
    """(doc_id, class_id, links, copies): a row for each document with words."""
    features, reps, once = _sets(docs, id_col, text_col, n)
    found = _compared(once, reps, tau, False)
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("sig")).agg(F.sum("links").alias("links"))
    some = _members(reps, found.where("b IS NOT NULL")).join(degree, "sig", "left").where("copies > 0 OR links > 0").select("sig", "class_id", "links", "copies")
    some = small_or_plain(materialize(some, "linked-sets"))
    zero = F.lit(0).cast("long")
    own = features.select("sig", "doc_id").distinct().join(some, "sig", "left")
    return own.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", zero).alias("links"), F.coalesce("copies", zero).alias("copies"))


def _nearest_classes(once: DataFrame, tau: float) -> DataFrame:
    """(a, b) near sets that lead to the same classes as all near pairs do, without all pairs of a key."""
    keys = materialize(key_table(once, tau).select("key", "sig", "n"), "keys")
    hubs = keys.groupBy("key").agg(F.min(F.struct("sig", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = keys.join(hubs, "key").select("key", "sig", "n", F.col("hub.sig").alias("hub"), F.col("hub.n").alias("hub_n"), "members")
    met = materialize(met.where("sig <> hub OR members > 2"), "meetings")
    drop_scratch(keys.sparkSession, keys)

    def allowed(a: str, b: str) -> str:
        return f"({a} > 0 OR {b} > 0) AND least(abs({a}), abs({b})) >= {tau}D * greatest(abs({a}), abs({b})) - 1e-9D"

    star = materialize(met.where("sig <> hub AND " + allowed("n", "hub_n")).select(F.col("hub").alias("a"), F.col("sig").alias("b")).distinct(), "candidates")
    near = _verified(once, star, tau).select("a", "b")
    roots = small_or_plain(materialize(components(near).withColumnRenamed("v", "sig"), "roots"))
    rest = met.where("members > 2").join(roots, "sig", "left").select("key", "sig", "n", "hub", F.coalesce("root", "sig").alias("root"))
    mixed = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = materialize(rest.where("sig <> hub").join(mixed, "key", "left_semi").select("key", "sig", "n", "root"), "mixed-keys")
    on = F.expr("l.key = r.key AND l.sig < r.sig AND l.root <> r.root AND " + allowed("l.n", "r.n"))
    more = rest.alias("l").join(rest.alias("r"), on).select(F.col("l.sig").alias("a"), F.col("r.sig").alias("b")).distinct()
    more = materialize(more.join(star, ["a", "b"], "left_anti"), "candidates")
    if more.isEmpty():
        return near
    return near.union(_verified(once, more, tau).select("a", "b"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, tau: float = TAU) -> DataFrame:
    """The rows of docs that stay: of each group linked by near pairs, the lowest doc_id.

    Rows without an id or words stay; rows equal in doc_id and text stay or go together.
    """
    ship(docs.sparkSession)
    features, reps, once = _sets(docs, id_col, text_col, n)
    member = _members(reps, _nearest_classes(once(), tau)).where("copies > 0 OR class_id <> first").select("sig", "class_id")
    member = small_or_plain(materialize(member, "members"))
    gone = features.select("sig", "doc_id", "th").join(member, "sig").where("doc_id <> class_id").select(F.col("doc_id").alias("g_doc"), F.col("th").alias("g_th")).distinct()
    gone = materialize(gone, "near-copies")
    key, th = fresh(docs, "k_doc"), fresh(docs, "k_th")
    full = docs.withColumns({key: quoted(id_col).cast("long"), th: F.xxhash64(quoted(text_col))})
    gone = small_or_plain(named_apart(full, gone))
    return full.join(gone, (full[key] == gone[gone.columns[0]]) & (full[th] == gone[gone.columns[1]]), "left_anti").drop(key, th)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SETS = """
w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_\\x{80}-\\x{10FFFF}]+') AS ws FROM {docs} WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS s
  FROM w WHERE len(ws) > 0
), r AS (
  SELECT s, min(doc_id) AS first, len(s) AS n, count(DISTINCT doc_id) AS copies FROM g GROUP BY s
), e AS (
  SELECT first, n, unnest(s) AS x FROM r
), p AS (
  SELECT a.first AS doc_a, b.first AS doc_b, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS jaccard
  FROM e a JOIN e b ON a.x = b.x AND a.first < b.first GROUP BY 1, 2
)"""

SQL = (
    "WITH RECURSIVE "
    + _SETS.replace("{docs}", "documents")
    + f"""
, near AS (SELECT doc_a, doc_b FROM p WHERE jaccard >= {TAU} - 1e-12
), ends AS (SELECT doc_a AS v, doc_b AS u FROM near UNION ALL SELECT doc_b, doc_a FROM near
), reach AS (
  SELECT v, v AS root FROM ends
  UNION
  SELECT ends.u, reach.root FROM reach JOIN ends ON reach.v = ends.v WHERE reach.root < ends.u
), class AS (SELECT v, min(root) AS root FROM reach GROUP BY v
), degree AS (SELECT v, count(*) AS links FROM ends GROUP BY v)
SELECT g.doc_id, coalesce(class.root, r.first) AS class_id, coalesce(degree.links, 0) AS links, r.copies - 1 AS copies
FROM g JOIN r ON g.s = r.s LEFT JOIN class ON class.v = r.first LEFT JOIN degree ON degree.v = r.first
"""
)
