"""Media columns: cropped or edited copies of images, by local descriptors.

Corners (Harris, non-maximum suppression) are found at scales down to the smallest usable side,
against the strongest of their cell, in batches of pictures of one size. Each has an
orientation from its patch's intensity centroid and 256 binary tests that are turned by it.
Descriptors meet in nine Hamming tables, each keyed by 28 of the tests. A table's tests are
chosen from a model of smooth pictures so that they say little about each other; else unlike
corners meet by the thousand. The tables are joined one after another, a table's shuffle being
given back before the next begins, and a meeting counts only if the whole descriptors differ in
FAR bits at most, which the join itself tests. Two images with a meeting within SURE bits, or
with two meetings, are a candidate: all their corners are then compared with each other, so a
candidate's matches are those of brute force. Every match of two oriented corners proposes a
similarity transform; the images are a pair if one proposal carries enough of their other
matches to their places (geometric consensus).

Images are decoded here from PGM, PPM or PNG (8 bit, not interlaced). Images with equal
bytes are one entity: the lowest id stands for it, and each other copy is paired with it, so
a thousand copies make a thousand rows and not a million.

The test tables hold no pictures, so the query renders one from each row of ``embeddings``:
the vector's values set the waves of a smooth field, and near vectors give near pictures.
About a twentieth of the pictures, by a hash of their ids, is followed by an edited copy with
the id -1 - id: cropped, turned, lightened, noisy or captioned. All of them are searched.

Defined results
- Null, broken and unsupported images, and images without corners, match nothing but equal
  bytes; a null image or a null id takes no part at all.
- A repeated id with different images is compared, but no id is paired with itself.
- A large picture is held in memory whole, some forty bytes for each of its pixels; corners are
  compared and proposals are counted in blocks of bounded size.
- An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import quoted, ship, table
from spanloom.plans.session import free_shuffles, materialize, small_or_plain

SCALES = (1.0, 1.4, 2.0)
RADIUS, SUPPRESS, STRENGTH = 9, 5, 0.05
#: Side of the cells in which a corner is held against the strongest one.
CELL = 16
TABLES, BITS, FAR = 9, 28, 40
#: Differing bits up to which a single meeting makes a candidate.
SURE = 34
#: Steps in which the tests are turned, pixels that are described at once, cells of a comparison block.
TURNS, BATCH_PIXELS, BLOCK = 128, 300_000, 2_000_000
MIN_INLIERS, TOLERANCE = 6, 4.0

_rng = np.random.default_rng(20240229)
_PAIRS = np.clip(_rng.normal(0, RADIUS / 2, (256, 4)), -RADIUS + 1, RADIUS - 1)
_g = np.arange(-RADIUS, RADIUS + 1)
_DISC_Y, _DISC_X = (z.ravel() for z in np.meshgrid(_g, _g, indexing="ij"))
_in = _DISC_X**2 + _DISC_Y**2 <= RADIUS**2
_DISC_X, _DISC_Y = _DISC_X[_in], _DISC_Y[_in]
MARGIN = RADIUS + 2


def _turned() -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the tests' first and second places at each of TURNS orientations."""
    t = np.arange(TURNS) * (2 * np.pi / TURNS)
    co, si = np.cos(t)[:, None], np.sin(t)[:, None]
    out = []
    for u in (0, 2):
        x = np.rint(co * _PAIRS[:, u] - si * _PAIRS[:, u + 1]).astype(int)
        y = np.rint(si * _PAIRS[:, u] + co * _PAIRS[:, u + 1]).astype(int)
        out.append((np.clip(y, -MARGIN, MARGIN), np.clip(x, -MARGIN, MARGIN)))
    return out


_TURNED = _turned()


def _table_tests(width: float = 2.5) -> list[np.ndarray]:
    """The BITS tests of each table.

    Grey levels are taken as a random field whose covariance falls off like a Gaussian of that
    width; the orientation fixes the patch's centroid. What is left of the tests' correlation and
    their bias is kept low within a table, test by test, and a test is seldom used twice.
    """
    places = np.rint(_PAIRS)
    first, second, disc = places[:, :2], places[:, 2:], np.stack([_DISC_X, _DISC_Y], 1).astype(float)

    def field(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.exp(-((u[:, None] - v[None]) ** 2).sum(2) / (2 * width**2))

    cov = field(first, first) - field(first, second) - field(second, first) + field(second, second)
    to_disc, inner = field(first, disc) - field(second, disc), field(disc, disc)
    along, across = to_disc @ disc[:, 0], to_disc @ disc[:, 1]
    spread_x, spread_y = disc[:, 0] @ inner @ disc[:, 0], disc[:, 1] @ inner @ disc[:, 1]
    cov -= np.outer(across, across) / spread_y + np.outer(along, along) / spread_x
    sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
    bias, corr = np.abs(along) / np.sqrt(spread_x) / sd, np.abs(cov / np.outer(sd, sd))
    rng, used, out = np.random.default_rng(7), np.zeros(256), []
    for _ in range(TABLES):
        cost, worst, picked = 0.5 * bias + 0.15 * used + 0.05 * rng.random(256), np.zeros(256), []
        for _ in range(BITS):
            c = worst + cost
            c[picked] = np.inf
            picked.append(int(np.argmin(c)))
            worst = np.maximum(worst, corr[picked[-1]])
        used[picked] += 1
        out.append(np.array(picked))
    return out


_TESTS = _table_tests()


def _unfiltered(kind: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Undo the row filters, a diagonal at a time: a place needs those left, above and left above it."""
    h, w, ch = raw.shape
    if not np.isin(kind, (1, 3, 4)).any():
        out = raw.astype(np.uint8)
        for y in np.flatnonzero(kind == 2):
            out[y] += out[y - 1] if y else 0
        return out
    out = np.zeros((h + 1, w + 1, ch), np.int16)
    for t in range(w + h - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        k = kind[y][:, None]
        e = a + b - c
        da, db, dc = np.abs(e - a), np.abs(e - b), np.abs(e - c)
        paeth = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        p = np.select([k == 1, k == 2, k == 3, k == 4], [a, b, (a + b) >> 1, paeth], 0)
        out[y + 1, x + 1] = (raw[y, x] + p) & 255
    return out[1:, 1:].astype(np.uint8)


def _png(b: bytes) -> np.ndarray | None:
    at, data, head, palette = 8, [], None, None
    while at + 8 <= len(b):
        n = int.from_bytes(b[at : at + 4], "big")
        kind, body = b[at + 4 : at + 8], b[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9], body[12])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[4] != 0 or head[3] not in (0, 2, 3, 4, 6):
        return None
    w, h, ch = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * ch)
    out = _unfiltered(raw[:, 0], raw[:, 1:].reshape(h, w, ch))
    img = out.reshape(h, w, ch)
    if head[3] == 3:
        if palette is None:
            return None
        img = palette[img[:, :, 0]]
    return img[:, :, :3].mean(2) if img.shape[2] >= 3 else img[:, :, 0].astype(float)


def decode(b: bytes | None) -> np.ndarray | None:
    """Grey levels as float32 (height, width), or None."""
    try:
        if not b:
            return None
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            img = _png(b)
        elif b[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while b[at : at + 1].isspace() or b[at : at + 1] == b"#":
                    at = b.index(b"\n", at) + 1 if b[at : at + 1] == b"#" else at + 1
                end = at
                while b[end : end + 1].isdigit():
                    end += 1
                fields.append(int(b[at:end]))
                at = end
            w, h, top = fields
            ch = 3 if b[:2] == b"P6" else 1
            if top > 255:
                return None
            img = np.frombuffer(b, np.uint8, w * h * ch, at + 1).reshape(h, w, ch).mean(2)
        else:
            img = None
        return None if img is None or not img.size else img.astype(np.float32)
    except (ValueError, IndexError, zlib.error):
        return None


def encode_pgm(img: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (img.shape[1], img.shape[0]) + np.clip(np.rint(img), 0, 255).astype(np.uint8).tobytes()


def render(v: np.ndarray, side: int = 96, waves: int = 14) -> np.ndarray:
    """(n, side, side) grey pictures of n vectors."""
    n, dim = v.shape
    r = np.random.default_rng(5).normal(0, 1, (dim, waves * 4))
    t = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)) @ r
    fx, fy, ph, am = (t[:, i * waves : (i + 1) * waves] for i in range(4))
    x = np.linspace(-1, 1, side)
    a = (fx * 45)[:, :, None] * x + (ph * 3)[:, :, None]
    b = (fy * 45)[:, :, None] * x
    w = (0.5 + np.abs(am))[:, :, None]
    img = np.matmul((w * np.cos(b)).transpose(0, 2, 1), np.cos(a)) - np.matmul((w * np.sin(b)).transpose(0, 2, 1), np.sin(a))
    return 127.5 + 120 * np.tanh(img / 2.5)


def _blur(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1 of (n, height, width), edges repeated."""
    k = 2 * r + 1
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.moveaxis(np.pad(x, pad, mode="edge"), axis, 0)
        n = x.shape[axis]
        if k <= 7:
            y = p[:n] + p[1 : n + 1]
            for i in range(2, k):
                y += p[i : n + i]
        else:
            c = np.cumsum(np.concatenate([np.zeros_like(p[:1]), p]), axis=0, dtype=np.float64)
            y = (c[k:] - c[:-k]).astype(np.float32)
        x = np.moveaxis(y, 0, axis)
    return np.ascontiguousarray(x / np.float32(k * k))


def _resize(x: np.ndarray, f: float) -> np.ndarray:
    """(n, height / f, width / f), bilinear."""
    h, w = int(x.shape[1] / f), int(x.shape[2] / f)
    yy, xx = (np.arange(h) + 0.5) * f - 0.5, (np.arange(w) + 0.5) * f - 0.5
    y0, x0 = np.minimum(yy.astype(int), x.shape[1] - 2), np.minimum(xx.astype(int), x.shape[2] - 2)
    wy, wx = (yy - y0).astype(np.float32)[:, None], (xx - x0).astype(np.float32)
    rows = x[:, y0] * (1 - wy) + x[:, y0 + 1] * wy
    return rows[:, :, x0] * (1 - wx) + rows[:, :, x0 + 1] * wx


def pyramid(imgs: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """(factor, pictures) by half octaves to SCALES' end, then by eighths down to the smallest side that holds a patch."""
    f, i = 1.0, 0
    while min(imgs.shape[1:]) / f >= 2 * RADIUS + 6:
        # what the coarser grid can't hold is smoothed away first
        x = _blur(imgs, int(f / 2)) if f > 2 else imgs
        yield f, _blur(x if f == 1 else _resize(x, f), 1)
        i += 1
        f = SCALES[i] if i < len(SCALES) else SCALES[-1] * 2 ** ((i - len(SCALES) + 1) / 8)


def _highest(r: np.ndarray) -> np.ndarray:
    """The largest value within SUPPRESS places, by doubling."""
    span = 2 * SUPPRESS + 1
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (SUPPRESS, SUPPRESS)
        a, k = np.moveaxis(np.pad(r, pad), axis, 0), 1
        while k < span:
            step = min(k, span - k)
            a, k = np.maximum(a[:-step], a[step:]), k + step
        r = np.moveaxis(a, 0, axis)
    return r


@cache
def _offsets(width: int) -> tuple[np.ndarray, ...]:
    return tuple(y * width + x for y, x in _TURNED)


def describe_many(imgs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(picture, (x, y, scale, angle), four words of bits) of each corner of equally large pictures, by picture."""
    n = len(imgs)
    found: list[tuple[np.ndarray, ...]] = []
    for f, x in pyramid(imgs.astype(np.float32)):
        h, w = x.shape[1:]
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = _blur(gx * gx, 2), _blur(gy * gy, 2), _blur(gx * gy, 2)
        edge = a + b
        harris = a * b - c * c - np.float32(0.05) * edge * edge
        m = MARGIN
        r = np.zeros_like(harris)
        np.maximum(harris[:, m:-m, m:-m], 0, out=r[:, m:-m, m:-m])
        cells = np.pad(r, ((0, 0), (0, -h % CELL), (0, -w % CELL)))
        cells = cells.reshape(n, cells.shape[1] // CELL, CELL, -1, CELL).max((2, 4))
        i, py, px = np.nonzero((r == _highest(r)) & (r > 1))
        on = r[i, py, px] > STRENGTH * cells[i, py // CELL, px // CELL]
        i, py, px = i[on], py[on], px[on]
        if not len(i):
            continue
        flat, at = x.ravel(), ((i * h + py) * w + px)[:, None]
        patch = flat.take(at + (_DISC_Y * w + _DISC_X)).astype(np.float64)
        patch -= patch.mean(1, keepdims=True)
        ang = np.arctan2((patch * _DISC_Y).sum(1), (patch * _DISC_X).sum(1))
        turn = np.rint(ang * (TURNS / (2 * np.pi))).astype(np.int64) % TURNS
        one, two = _offsets(w)
        bits = flat.take(at + one[turn]) < flat.take(at + two[turn])
        found.append((i, np.stack([(px + 0.5) * f - 0.5, (py + 0.5) * f - 0.5, np.full(len(px), f), ang], 1), np.packbits(bits, axis=1).view(np.int64).reshape(-1, 4)))
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, 4), np.int64)
    i, p, code = (np.concatenate(z) for z in zip(*found, strict=True))
    order = np.argsort(i, kind="stable")
    return i[order], p[order], code[order]


def describe(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) and four words of bits of each corner."""
    return describe_many(img[None])[1:]


def table_keys(codes: np.ndarray, t: int) -> np.ndarray:
    """The key of each descriptor in table t."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 32), axis=1)[:, _TESTS[t]]
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, 8 - packed.shape[1])))).view(np.int64).ravel()


def band_keys(codes: np.ndarray) -> np.ndarray:
    """(corners, TABLES) keys."""
    return np.stack([table_keys(codes, t) for t in range(TABLES)], 1) if len(codes) else np.zeros((0, TABLES), np.int64)


_CORNERS = "sig long, places array<float>, codes array<long>"


def _described(imgs: list[np.ndarray | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places and codes of each picture; pictures of one size are described together."""
    places: list[np.ndarray] = [np.zeros((0, 4))] * len(imgs)
    codes: list[np.ndarray] = [np.zeros((0, 4), np.int64)] * len(imgs)
    for shape in {x.shape for x in imgs if x is not None}:
        on = [i for i, x in enumerate(imgs) if x is not None and x.shape == shape]
        step = max(1, BATCH_PIXELS // (shape[0] * shape[1]))
        for lo in range(0, len(on), step):
            part = on[lo : lo + step]
            i, p, c = describe_many(np.stack([imgs[k] for k in part]))
            cut = np.searchsorted(i, np.arange(len(part) + 1))
            for j, k in enumerate(part):
                places[k], codes[k] = p[cut[j] : cut[j + 1]], c[cut[j] : cut[j + 1]]
    return places, codes


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([r.size for r in rows])]).astype(np.int32)), pa.array(flat).cast(kind))


def corner_table(images: DataFrame) -> DataFrame:
    """(sig, places, codes): a row for each picture of (sig, image), four numbers and four words for each corner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                places, codes = _described([decode(x) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(places, pa.float32()), _lists(codes, pa.int64())], names=["sig", "places", "codes"])

    return images.select("sig", "image").mapInArrow(run, _CORNERS)


def _list_values(col: pa.Array, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(offsets in corners, (corners, width)) of a list column."""
    lists = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) // width, lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _table_rows(corners: DataFrame, t: int) -> DataFrame:
    """(key, sig, k, d0, .. d3) of all corners in table t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                off, codes = _list_values(part.column(1))
                n = np.diff(off)
                k = np.arange(off[-1]) - np.repeat(off[:-1], n)
                words = [pa.array(np.ascontiguousarray(codes[:, i])) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(table_keys(codes, t) if len(codes) else np.zeros(0, np.int64)), part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(k, pa.int32()), *words], names=["key", "sig", "k", "d0", "d1", "d2", "d3"])

    return corners.select("sig", "codes").mapInArrow(run, "key long, sig long, k int, d0 long, d1 long, d2 long, d3 long")


def _meetings(corners: DataFrame, t: int, far: int) -> DataFrame:
    """(a, ka, b, kb, dist) of the corners of two pictures that meet in table t and differ in few bits."""
    rows = _table_rows(corners, t)
    dist = " + ".join(f"bit_count(l.d{i} ^ r.d{i})" for i in range(4))
    on = F.expr(f"l.key = r.key AND l.sig < r.sig AND {dist} <= {far}")
    met = rows.alias("l").join(rows.alias("r"), on).selectExpr("l.sig AS a", "l.k AS ka", "r.sig AS b", "r.k AS kb", f"CAST({dist} AS INT) AS dist")
    return materialize(met, f"meetings-{t}")


def consensus(m: np.ndarray) -> tuple[int, float, float, float, float]:
    """Most inliers of one match's similarity, and its scale, angle and shift.

    m has per match x, y, s, angle of the one corner and of the other. Inliers are counted
    by their distinct places in both images.
    """
    xa, ya, sa, ra, xb, yb, sb, rb = m.T
    s, t = sb / sa, rb - ra
    co, si = s * np.cos(t), s * np.sin(t)
    dx, dy = xb - (co * xa - si * ya), yb - (si * xa + co * ya)
    sorts = []
    for x, y in ((xa, ya), (xb, yb)):
        place = np.rint(x / 6) * 4096 + np.rint(y / 6)
        order = np.argsort(place, kind="stable")
        sorts.append((order, np.nonzero(np.diff(place[order], prepend=-np.inf))[0]))
    best = (0, 0)
    step = max(1, BLOCK // len(m))
    for lo in range(0, len(m), step):
        p = slice(lo, lo + step)
        ex = co[p, None] * xa - si[p, None] * ya + dx[p, None] - xb
        ey = si[p, None] * xa + co[p, None] * ya + dy[p, None] - yb
        turn = np.abs((t[p, None] - t[None] + np.pi) % (2 * np.pi) - np.pi)
        ok = (ex * ex + ey * ey <= (TOLERANCE * np.maximum(1, s[p, None])) ** 2) & (turn < 0.6)
        n = np.min([np.logical_or.reduceat(ok[:, order], starts, axis=1).sum(1) for order, starts in sorts], axis=0)
        best = max(best, (int(n.max()), -(lo + int(n.argmax()))))
    i = -best[1]
    return best[0], float(s[i]), float((t[i] + np.pi) % (2 * np.pi) - np.pi), float(dx[i]), float(dy[i])


def matches(ca: np.ndarray, cb: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ca and cb of the descriptors that differ in far bits at most."""
    step = max(1, BLOCK // max(1, len(cb)))
    found = [np.nonzero(np.bitwise_count(ca[lo : lo + step, None] ^ cb[None]).sum(2, dtype=np.int16) <= far) for lo in range(0, len(ca), step)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i + lo for (i, _), lo in zip(found, range(0, len(ca), step), strict=True)]), np.concatenate([k for _, k in found])


def _agree(min_inliers: int, far: int):
    """Compare all corners of each (a, b, places and codes of a, places and codes of b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (oa, pa_), (_, ca), (ob, pb), (_, cb) = (_list_values(batch.column(i)) for i in range(2, 6))
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = []
            for n, (a, b) in enumerate(ids):
                x, y = slice(oa[n], oa[n + 1]), slice(ob[n], ob[n + 1])
                i, k = matches(ca[x], cb[y], far)
                if len(i) >= min_inliers:
                    got = consensus(np.concatenate([pa_[x][i], pb[y][k]], 1).astype(np.float64))
                    if got[0] >= min_inliers:
                        rows.append((a, b, len(i), *got))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "matches", "inliers", "scale", "angle", "dx", "dy"])

    return run


def candidates(corners: DataFrame, far: int = FAR) -> DataFrame:
    """(a, b): pictures with a meeting within SURE bits or with two meetings, table after table."""
    met = None
    for t in range(TABLES):
        one = _meetings(corners, t, far)
        met = one if met is None else met.union(one)
        free_shuffles(corners.sparkSession)
    pairs = met.groupBy("a", "b").agg(F.min("dist").alias("least"), F.min(F.struct("ka", "kb")).alias("first"), F.max(F.struct("ka", "kb")).alias("last"))
    return materialize(pairs.where((F.col("least") <= SURE) | (F.col("first") != F.col("last"))).select("a", "b"), "media-pairs")


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 128) -> Iterator[None]:
    """Few rows in a batch between Spark and Python, as a row may be a picture or its corners."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def find_copies(media: DataFrame, id_col: str = "id", image_col: str = "image", min_inliers: int = MIN_INLIERS, far: int = FAR) -> DataFrame:
    """(id_a, id_b, kind, matches, inliers, scale, angle, dx, dy), id_a < id_b; kind is equal or edited."""
    ship(media.sparkSession)
    with _small_batches(media.sparkSession):
        named = media.select(quoted(id_col).cast("long").alias("id"), quoted(image_col).alias("image")).where("id IS NOT NULL AND image IS NOT NULL")
        ids = materialize(named.select("id", F.xxhash64("image").alias("sig")), "media-ids")
        first = materialize(ids.groupBy("sig").agg(F.min("id").alias("first")), "media-first")
        spare = materialize(ids.join(first, "sig").where("id <> first").select(F.col("sig").alias("p_sig"), F.col("id").alias("p_id")).distinct(), "media-spare")
        once = named.withColumn("sig", F.xxhash64("image")).join(small_or_plain(spare), (F.col("sig") == F.col("p_sig")) & (F.col("id") == F.col("p_id")), "left_anti")
        corners = materialize(corner_table(once), "corners")
        free_shuffles(media.sparkSession)
        cand = candidates(corners, far)
        one = corners.select(F.col("sig").alias("a"), F.col("places").alias("xp"), F.col("codes").alias("xc"))
        two = corners.select(F.col("sig").alias("b"), F.col("places").alias("yp"), F.col("codes").alias("yc"))
        rows = cand.join(one, "a").join(two, "b").select("a", "b", "xp", "xc", "yp", "yc")
        found = rows.mapInArrow(_agree(min_inliers, far), "a long, b long, matches long, inliers long, scale double, angle double, dx double, dy double")
        # repeated rows describe a picture twice
        found = materialize(found.dropDuplicates(["a", "b"]), "media-found")
        free_shuffles(media.sparkSession)
    edited = (
        found.join(first.select(F.col("sig").alias("a"), F.col("first").alias("ia")), "a")
        .join(first.select(F.col("sig").alias("b"), F.col("first").alias("ib")), "b")
        .where("ia <> ib")
        .select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), F.lit("edited").alias("kind"), "matches", "inliers", *(F.when(F.col("ia") < F.col("ib"), F.col(c)).otherwise(F.lit(None)).alias(c) for c in ("scale", "angle", "dx", "dy")), F.col("scale").alias("rs"), F.col("angle").alias("ra"), F.col("dx").alias("rx"), F.col("dy").alias("ry"))
    )
    # the other way round, the transform is the inverse
    inv_co, inv_si = F.cos(F.col("ra")) / F.col("rs"), -F.sin(F.col("ra")) / F.col("rs")
    edited = edited.select(
        "id_a", "id_b", "kind", "matches", "inliers",
        F.coalesce("scale", 1 / F.col("rs")).alias("scale"),
        F.coalesce("angle", -F.col("ra")).alias("angle"),
        F.coalesce("dx", -(inv_co * F.col("rx") - inv_si * F.col("ry"))).alias("dx"),
        F.coalesce("dy", -(inv_si * F.col("rx") + inv_co * F.col("ry"))).alias("dy"),
    )
    zero = F.lit(0).cast("long")
    equal = ids.join(first, "sig").where("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit("equal").alias("kind"), zero.alias("matches"), zero.alias("inliers"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("angle"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")).distinct()
    return edited.unionByName(equal)


def rendered(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, image): a PGM picture per vector; null for a null or empty vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                vs = part.column(1).to_pylist()
                out: list[bytes | None] = [None] * len(vs)
                for dim in {len(v) for v in vs if v}:
                    on = [i for i, v in enumerate(vs) if v and len(v) == dim]
                    for i, img in zip(on, render(np.array([[z or 0.0 for z in vs[i]] for i in on], float)), strict=True):
                        out[i] = encode_pgm(img)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["id", "image"])

    return embeddings.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, image binary")


EDITS = ("crop", "turn", "light", "noise", "caption")


def edited(img: np.ndarray, how: str, seed: int) -> np.ndarray:
    """A copy of a picture that was cropped, turned by a quarter, lightened, made noisy or captioned."""
    h, w = img.shape
    if how == "crop":
        return img[h // 12 : h - h // 10, w // 10 : w - w // 14]
    if how == "turn":
        return np.rot90(img)
    if how == "light":
        return img * 0.75 + 35
    if how == "noise":
        return img + np.random.default_rng(seed).normal(0, 3, img.shape)
    out = img.copy()
    out[h * 3 // 4 : h * 7 // 8, w // 8 : w * 7 // 8] = 235
    out[h * 25 // 32 : h * 27 // 32, w // 6 : w * 5 // 6 : 3] = 20
    return out


def with_copies(pictures: DataFrame, one_in: int = 20) -> DataFrame:
    """pictures and, for about one in so many by a hash of the id, an edited copy under -1 - id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            ids, images = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32 if i is not None else 1
                if h % one_in == 0 and (img := decode(x)) is not None:
                    ids.append(-1 - i)
                    images.append(encode_pgm(edited(img, EDITS[h // one_in % len(EDITS)], i & 0xFFFF)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["id", "image"])

    return pictures.select("id", "image").mapInArrow(run, "id long, image binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(with_copies(rendered(table(spark, sf_dir, "embeddings"))))
