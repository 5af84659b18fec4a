"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE_WORDS tokens, the whole text being covered. Each
passage is described by numpy from its bytes (shape bigrams, hashed words, repetition) and
encoded by a learned ReLU layer. A gated attention unit, softmax over w . (tanh(V h) *
sigmoid(U h)), weighs the passages of a document, and a logistic unit scores the weighted
sum. Labels exist per document only; encoder, gates and scorer are learned from them
together in numpy (Adam) on the driver. A share held out of training sets the threshold.

Defined results
- The score is the probability of good quality; a document is rejected below the threshold.
- Tokens are runs of bytes other than space, tab, newline, carriage return.
- A null, empty or blank text has no passage: its score is null and it is kept.
- Without labelled rows of both classes there is no model: no score, everything is kept.
- Of labelled rows with one doc_id one is fitted. A text whose features don't fit into what is left
  of TRAIN_BYTES is passed over in fitting; every text is scored whole.
- Equal rows are scored alike. Other columns are ignored, whatever their names; ``filter_docs``
  passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bytesvec
from spanloom.llm.common import map_batches, map_rows, quoted, ship, slices, text_bytes
from spanloom.llm.labelled import best_threshold, collected, one_row_each, sample

#: Labelled documents used for fitting and calibration, and bytes of their features on the driver (half precision).
TRAIN_DOCS, TRAIN_BYTES = 3000, 96_000_000
PASSAGE_WORDS, HIDDEN, GATE, EPOCHS, WORD_DIMS = 64, 24, 12, 12, 128
#: Text bytes described in one pass, which takes about a hundred bytes of memory for each.
PASS_BYTES = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 13]] = True


def _classes() -> np.ndarray:
    c = np.full(256, 3, np.int64)  # other control and rare signs
    c[97:123], c[65:91], c[48:58], c[128:] = 0, 1, 2, 4
    c[[32, 9]], c[[10, 13]] = 5, 6
    for k, signs in enumerate((".", ",", ";:", "!", "?", "|", "#", "$%&", "*", "'\"`", "()[]{}", "@", "-_", "/\\", "<>=+~^"), 7):
        c[[ord(s) for s in signs]] = k
    return c


_CLASS = _classes()
N_CLASS = int(_CLASS.max()) + 1
DIMS = N_CLASS * N_CLASS + WORD_DIMS + 5


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, passages of each document)."""
    n_docs = len(offsets) - 1
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    d = np.diff(solid)
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[(solid[cut] == 1) & (solid[cut + 1] == 1)] if len(cut) else cut
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    if not len(starts):
        return np.zeros((0, DIMS), np.float32), np.zeros(n_docs, np.int64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    bags = -(-counts // PASSAGE_WORDS)
    base = np.cumsum(bags) - bags
    pas = base[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE_WORDS
    n = int(bags.sum())
    size = np.bincount(pas, minlength=n).astype(np.float64)
    p_first = np.flatnonzero(np.concatenate([[True], pas[1:] != pas[:-1]]))
    # bytes of a passage: from its first token to where the next passage, or its document, ends
    p_end = np.append(starts[p_first[1:]], len(data))
    p_end = np.minimum(p_end, offsets[doc[p_first] + 1])
    out = np.zeros((n, DIMS), np.float32)
    cls = _CLASS[data]
    code = cls[:-1] * N_CLASS + cls[1:]
    lens = np.maximum(p_end - starts[p_first] - 1, 0)
    at = np.arange(int(lens.sum())) + np.repeat(starts[p_first] - (np.cumsum(lens) - lens), lens)
    k = N_CLASS * N_CLASS
    hist = np.bincount(np.repeat(np.arange(n), lens) * k + code[at], minlength=n * k).reshape(n, k)
    out[:, :k] = np.sqrt(hist / np.maximum(lens, 1)[:, None])
    h = bytesvec.word_hashes(data, starts, ends)
    w = np.bincount(pas * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64), minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    out[:, k : k + WORD_DIMS] = np.sqrt(w / size[:, None])
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    tag = (pas.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    tag.sort()
    kinds = np.bincount((tag[np.concatenate([[True], tag[1:] != tag[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=n)
    out[:, -5] = np.bincount(pas, again, minlength=n) / size
    out[:, -4] = kinds / size
    out[:, -3] = np.minimum(np.bincount(pas, ends - starts, minlength=n) / size / 10, 5)
    out[:, -2] = np.log1p(size) / 5
    out[:, -1] = 1
    return out, bags


@dataclass
class Mil:
    """Encoder w1, gates v and u, attention a, scorer c with bias."""

    w1: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    threshold: float = 0.5


def _forward(m: Mil, x: np.ndarray, bags: np.ndarray) -> tuple:
    doc = np.repeat(np.arange(len(bags)), bags)
    first = np.cumsum(bags) - bags
    h = np.maximum(x @ m.w1, 0)
    t, s = np.tanh(h @ m.v), 1 / (1 + np.exp(-(h @ m.u)))
    e = (t * s) @ m.a
    e = np.exp(e - np.maximum.reduceat(e, first)[doc])
    att = e / np.add.reduceat(e, first)[doc]
    z = np.add.reduceat(h * att[:, None], first, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ m.c[:-1] + m.c[-1], -30, 30)))
    return doc, h, t, s, att, z, p


def score(m: Mil, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
    """Probability of good quality per document; NaN for one without a passage."""
    p = np.full(len(bags), np.nan)
    some = bags > 0
    if some.any():
        p[some] = _forward(m, x, bags[some])[-1]
    return p


def gradients(m: Mil, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss, and of the encoder's penalty, at the parameters."""
    doc, h, t, s, att, z, p = _forward(m, x, bags)
    dl = ((p - y) * weight).astype(x.dtype)
    dz = dl[:, None] * m.c[:-1]
    dh = att[:, None] * dz[doc]
    da = (h * dz[doc]).sum(1)
    mean = np.add.reduceat(da * att, np.cumsum(bags) - bags)[doc]
    de = (att * (da - mean)).astype(x.dtype)
    dt, ds = de[:, None] * m.a * s * (1 - t * t), de[:, None] * m.a * t * s * (1 - s)
    dh = (dh + dt @ m.v.T + ds @ m.u.T) * (h > 0)
    return {"w1": x.T @ dh + 1e-4 * m.w1, "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": np.append(z.T @ dl, dl.sum())}


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = EPOCHS, batch: int = 32) -> Mil:
    rng = np.random.default_rng(seed)
    f = np.float32
    m = Mil(rng.normal(0, 0.15, (DIMS, HIDDEN)).astype(f), rng.normal(0, 0.3, (HIDDEN, GATE)).astype(f), rng.normal(0, 0.3, (HIDDEN, GATE)).astype(f), rng.normal(0, 0.3, GATE).astype(f), np.append(rng.normal(0, 0.3, HIDDEN), 0).astype(f))
    names = ("w1", "v", "u", "a", "c")
    m1 = {k: np.zeros_like(getattr(m, k)) for k in names}
    m2 = {k: np.zeros_like(getattr(m, k)) for k in names}
    first = np.cumsum(bags) - bags
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for b in range(0, len(order), batch):
            ids = order[b : b + batch]
            k = bags[ids]
            at = np.arange(int(k.sum())) + np.repeat(first[ids] - (np.cumsum(k) - k), k)
            xb = x[at].astype(f)
            grads = gradients(m, xb, k, y[ids], weight[ids] / len(ids))
            step += 1
            for name in names:
                g = grads[name]
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.999 * m2[name] + 0.001 * g * g
                change = 3e-3 * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
                setattr(m, name, (getattr(m, name) - change).astype(f))
    return m


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in slices(b.column("text"), PASS_BYTES):
            part = b.slice(lo, hi - lo)
            x, bags = passages(*text_bytes(part.column("text")))
            off = np.concatenate([[0], np.cumsum(bags)])
            packed = [x[off[i] : off[i + 1]].astype(np.float16).tobytes() for i in range(len(bags))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(packed, pa.binary())], names=["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, held_out: float = 0.25, seed: int = 11) -> Mil | None:
    """Train on at most train_docs labelled documents of train_bytes together, and set the threshold on a part of them."""
    ship(docs.sparkSession)
    chosen = sample(labels, "quality", train_docs)
    d = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    got = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    got = one_row_each(got.where("text IS NOT NULL"))
    t = collected(map_batches(got, _described, "doc_id long, y int, x binary"), "x", train_bytes)
    raw = t.column("x").to_pylist()
    keep = [i for i, r in enumerate(raw) if r]
    if not keep:
        return None
    y = t.column("y").to_numpy()[keep].astype(float)
    if y.min() == y.max():
        return None
    x = [np.frombuffer(raw[i], np.float16).reshape(-1, DIMS) for i in keep]
    bags = np.array([len(r) for r in x])
    test = np.random.default_rng(seed).random(len(y)) < held_out
    if not test.any() or y[~test].min() == y[~test].max():
        test[:] = False
    fitted = [r for r, z in zip(x, test, strict=True) if not z]
    model = train(np.concatenate(fitted), bags[~test], y[~test], seed)
    pick = np.flatnonzero(test) if test.any() else np.arange(len(y))
    p = score(model, np.concatenate([x[i] for i in pick]).astype(np.float32), bags[pick])
    model.threshold = 1 - best_threshold(1 - p, y[pick] == 0, 0.5)
    return model


def _scores(m: Mil, col: pa.Array) -> np.ndarray:
    return score(m, *passages(*text_bytes(col)))


def classify(docs: DataFrame, model: Mil | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep) for each row."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    if model is None:
        return d.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi in slices(b.column(1), PASS_BYTES):
                part = b.slice(lo, hi - lo)
                p = _scores(m, part.column(1))
                with np.errstate(invalid="ignore"):
                    keep = ~(p <= m.threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64(), mask=np.isnan(p)), pa.array(keep)], names=["doc_id", "score", "keep"])

    return map_batches(d, run, "doc_id long, score double, keep boolean")


def filter_docs(docs: DataFrame, model: Mil | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with their columns: one pass, no join."""
    spark = docs.sparkSession
    ship(spark)
    if model is None:
        return docs
    at = docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi in slices(b.column(at), PASS_BYTES):
                part = b.slice(lo, hi - lo)
                p = _scores(m, part.column(at))
                with np.errstate(invalid="ignore"):
                    yield part.filter(pa.array(~(p <= m.threshold)))

    return map_rows(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
