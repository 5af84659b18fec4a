import zlib

import numpy as np
import pytest

from spanloom.llm import media


def picture(seed, side=96):
    return media.render(np.random.default_rng(seed).normal(0, 1, (1, 16)), side)[0]


def png(img):
    h, w = img.shape
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    raw = b"".join(b"\x00" + np.clip(np.rint(r), 0, 255).astype(np.uint8).tobytes() for r in img)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def filtered_png(img, kind):
    """An RGB picture with one filter on every row, or all of them in turn."""
    h, w, ch = img.shape
    rows, x = [], img.astype(int)
    for y in range(h):
        k = y % 5 if kind is None else kind
        up = x[y - 1] if y else np.zeros((w, ch), int)
        left, corner = (np.vstack([np.zeros((1, ch), int), z[:-1]]) for z in (x[y], up))
        e = left + up - corner
        da, db, dc = abs(e - left), abs(e - up), abs(e - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        rows.append(bytes([k]) + ((x[y] - (0, left, up, (left + up) // 2, paeth)[k]) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4, None])
def test_png_filters(kind):
    img = np.random.default_rng(kind or 0).integers(0, 256, (23, 17, 3))
    assert np.allclose(media.decode(filtered_png(img, kind)), img.mean(2), atol=1e-3)


def rotate(img, deg):
    h, w = img.shape
    t = np.deg2rad(deg)
    y, x = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.cos(t) * (x - cx) + np.sin(t) * (y - cy) + cx
    sy = -np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy
    return img[np.clip(np.rint(sy), 0, h - 1).astype(int), np.clip(np.rint(sx), 0, w - 1).astype(int)]


SCHEMA = "id long, image binary"


def pairs(df, **kw):
    return {(r.id_a, r.id_b): r for r in media.find_copies(df, **kw).collect()}


def test_decode():
    img = np.rint(np.clip(picture(0, 40), 0, 255))
    assert np.array_equal(media.decode(png(img)), img) and np.array_equal(media.decode(media.encode_pgm(img)), img)
    rgb = b"P6\n2 1\n255\n" + bytes([3, 6, 9, 0, 0, 3])
    assert media.decode(rgb).tolist() == [[6, 1]]
    for bad in (None, b"", b"junk", b"P5\n9 9\n255\nxx", png(img)[:60], b"P5\n0 0\n255\n"):
        assert media.decode(bad) is None


def test_edited_copies(spark):
    rows, want = [], set()
    edits = [
        lambda x: x[8:84, 10:90], lambda x: x * 0.7 + 30, lambda x: x + np.random.default_rng(1).normal(0, 4, x.shape), lambda x: np.pad(x, 12, constant_values=128),
        lambda x: rotate(x, 90), lambda x: np.where(np.add.outer(np.arange(96) < 30, np.arange(96) < 30) == 2, 0, x),
    ]
    for i in range(18):
        x = picture(100 + i)
        rows += [(2 * i, media.encode_pgm(x)), (2 * i + 1, media.encode_pgm(edits[i % len(edits)](x)))]
        want.add((2 * i, 2 * i + 1))
    got = pairs(spark.createDataFrame(rows, SCHEMA))
    assert set(got) <= want and len(got) >= 0.9 * len(want)
    crop = got.get((0, 1))
    assert crop and crop.scale == pytest.approx(1, abs=0.05) and crop.dx == pytest.approx(-10, abs=1.5) and crop.dy == pytest.approx(-8, abs=1.5)


def shrunk(img, n):
    h, w = (z // n * n for z in img.shape)
    return img[:h, :w].reshape(h // n, n, w // n, n).mean((1, 3))


def captioned(img):
    out = img * 0.12 + 110
    out[70:92, 10:60], out[74:88, 14:56:4] = 255, 0
    return out


@pytest.mark.parametrize(("side", "edit"), [(384, lambda x: shrunk(x, 4)), (288, lambda x: shrunk(x, 3)), (96, lambda x: media._resize(x[None], 1 / 3)[0]), (96, captioned)], ids=["x0.25", "x0.33", "x3", "caption"])
def test_resized_and_captioned(side, edit):
    """Thumbnails, enlarged copies, and a caption with eight times the picture's contrast."""
    found = 0
    for i in range(10):
        x = picture(100 + i, side)
        (pa, ca), (pb, cb) = (media.describe(media.decode(media.encode_pgm(z))) for z in (x, edit(x)))
        i, k = np.nonzero(np.bitwise_count(ca[:, None] ^ cb[None]).sum(2) <= media.FAR)
        met = (media.band_keys(ca)[i] == media.band_keys(cb)[k]).any()
        found += bool(met) and media.consensus(np.concatenate([pa[i], pb[k]], 1))[0] >= media.MIN_INLIERS
    assert found >= 9


def smooth_turn(img, deg):
    """Turned by any angle, bilinear."""
    h, w = img.shape
    t = np.deg2rad(deg)
    y, x = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.clip(np.cos(t) * (x - cx) + np.sin(t) * (y - cy) + cx, 0, w - 1.001)
    sy = np.clip(-np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy, 0, h - 1.001)
    x0, y0 = sx.astype(int), sy.astype(int)
    fx, fy = sx - x0, sy - y0
    return (img[y0, x0] * (1 - fx) + img[y0, x0 + 1] * fx) * (1 - fy) + (img[y0 + 1, x0] * (1 - fx) + img[y0 + 1, x0 + 1] * fx) * fy


def all_pairs(rows, far=media.FAR):
    """Pairs by comparing all corners of all pictures."""
    found, out = {k: media.describe(media.decode(b)) for k, b in rows}, set()
    for a, (pa, ca) in found.items():
        for b, (pb, cb) in found.items():
            if a < b:
                i, k = np.nonzero(np.bitwise_count(ca[:, None] ^ cb[None]).sum(2) <= far)
                if len(i) >= media.MIN_INLIERS and media.consensus(np.concatenate([pa[i], pb[k]], 1))[0] >= media.MIN_INLIERS:
                    out.add((a, b))
    return out


KINDS = {
    "crop": (96, lambda x: x[4:90, 6:92]), "light": (96, lambda x: x * 0.8 + 10), "turn90": (96, lambda x: rotate(x, 90)), "noise": (96, lambda x: x + np.random.default_rng(1).normal(0, 4, x.shape)),
    "caption": (96, lambda x: captioned(x)), "half": (192, lambda x: shrunk(x, 2)), "third": (288, lambda x: shrunk(x, 3)), "threefold": (96, lambda x: media._resize(x[None], 1 / 3)[0]),
    "turn5": (96, lambda x: smooth_turn(x, 5)), "turn17": (96, lambda x: smooth_turn(x, 17)),
}


def test_against_all_pairs(spark):
    """The search against every pair of descriptors, kind by kind; small turns are the hard ones."""
    rows, kind = [], {}
    for n, (name, (side, edit)) in enumerate(KINDS.items()):
        for i in range(10):
            x, k = picture(3000 + 50 * n + i, side), 2 * (20 * n + i)
            rows += [(k, media.encode_pgm(x)), (k + 1, media.encode_pgm(edit(x)))]
            kind[(k, k + 1)] = name
    want = all_pairs(rows)
    got = set(pairs(spark.createDataFrame(rows, SCHEMA)))
    assert got <= want and len(want) >= 80
    share = {name: sum(p in got for p in want if kind.get(p) == name) / max(1, sum(kind.get(p) == name for p in want)) for name in KINDS}
    assert all(v == 1 for k, v in share.items() if k not in ("turn5", "turn17", "third", "threefold")), share
    lost = {name: sum(p not in got for p in want if kind.get(p) == name) for name in KINDS}
    assert max(lost.values()) <= 1 and len(got) >= 0.98 * len(want), (lost, len(got), len(want))


def test_query_finds_the_planted_copies(spark, data):
    """The whole query against all pairs of the pictures it searches."""
    pictures = media.with_copies(media.rendered(spark.read.parquet(f"{data}/embeddings.parquet")))
    rows = [(r.id, bytes(r.image)) for r in pictures.collect()]
    planted = {(-1 - i, i) for i, _ in rows if i >= 0} & {(i, -1 - i) for i, _ in rows}
    want = all_pairs(rows)
    got = {(r.id_a, r.id_b): r.kind for r in media.query(spark, data).collect()}
    assert planted and len(planted & set(got)) >= 0.98 * len(planted)
    assert set(got) <= want and len(got) >= 0.98 * len(want) and set(got.values()) <= {"edited"}


def test_blocks_change_nothing(monkeypatch):
    (pa, ca), (pb, cb) = (media.describe(picture(5)), media.describe(picture(5) * 0.8 + 9))
    i, k = media.matches(ca, cb, media.FAR)
    whole = media.consensus(np.concatenate([pa[i], pb[k]], 1))
    monkeypatch.setattr(media, "BLOCK", 7)
    j, m = media.matches(ca, cb, media.FAR)
    assert np.array_equal(i, j) and np.array_equal(k, m) and media.consensus(np.concatenate([pa[i], pb[k]], 1)) == whole
    assert len(media.matches(ca[:0], cb, 40)[0]) == 0 and len(media.matches(ca, cb[:0], 40)[0]) == 0


def test_pictures_are_described_alike_in_any_batch():
    x = np.stack([picture(k) for k in range(5)])
    i, p, c = media.describe_many(x)
    for k in range(5):
        one, code = media.describe(x[k])
        assert np.array_equal(code, c[i == k]) and np.allclose(one, p[i == k])


def test_odd_rows(spark):
    a, b = media.encode_pgm(picture(7)), media.encode_pgm(picture(8))
    flat = media.encode_pgm(np.full((50, 50), 9.0))
    rows = [(1, a), (2, a), (2, a), (2, b), (3, None), (None, a), (4, b""), (5, b""), (6, flat), (7, b"junk"), (8, media.encode_pgm(picture(9, 4)))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS sig", "2 AS k", "3 AS `dotted.name`")
    got = pairs(df)
    assert {k: r.kind for k, r in got.items()} == {(1, 2): "equal", (4, 5): "equal"}
    assert pairs(df.limit(0)) == {}


def test_many_copies(spark):
    a = media.encode_pgm(picture(11))
    assert set(pairs(spark.createDataFrame([(i, a) for i in range(300)], SCHEMA))) == {(0, i) for i in range(1, 300)}


def test_rendered_table(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, None), (3, []), (4, [0.5, None])], "vec_id long, embedding array<float>")
    got = {r.id: r.image for r in media.rendered(df).collect()}
    assert got[1][:2] == b"P5" and got[2] is None and got[3] is None and got[4] is not None
