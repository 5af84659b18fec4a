"""BPE encoding and decoding with the rank file of a public tokenizer.

A text is split by the tokenizer's pattern; each distinct piece is merged once per worker.
The merge keeps the symbols in a doubly linked list and the adjacent pairs in a priority
queue of (rank, position); a popped entry whose symbols have changed since is stale and
skipped. That is O(n log n) in the piece's length, so a piece of a million characters
needs no limit. The rank file is read by the driver and broadcast, about a megabyte
whatever the corpus, so no executor needs a copy of it. Decoding concatenates the vocabulary's byte strings, gathered by numpy.

Defined results
- A null text gives null ids and a null text back; the empty text gives no ids and ''.
- Strings of special tokens in a text are ordinary text.
- Ids that aren't in the vocabulary, and nulls in a list, make decode raise ValueError; bytes that are no UTF-8
  are decoded with U+FFFD in their place. A null id list decodes to null.
- Equal rows give equal rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import list_array, quoted, slices, string_array, table, text_bytes

#: Rank file and pattern; the path is a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pieces that a worker remembers before it begins anew; it only saves time.
MEMO_PIECES = 400_000


class Bpe:
    """A vocabulary of byte strings with their ranks; a token's id is its rank."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN, data: bytes | None = None):
        lines = (read(path) if data is None else data).splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern)
        self.memo: dict[str, np.ndarray] = {}
        top = max(self.ranks.values()) + 1
        by_id = [b""] * top
        self.known = np.zeros(top, bool)
        for token, i in self.ranks.items():
            by_id[i] = token
            self.known[i] = True
        self.lens = np.fromiter(map(len, by_id), np.int64, top)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece, by merging the pair of the lowest rank, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends = list(range(1, n + 1))  # symbol i is piece[i:ends[i]]; 0 marks one that was merged away
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, end = pop(queue)
            j = right[i]
            if ends[i] == 0 or j >= n or ends[j] != end:
                continue  # stale
            ends[i], ends[j] = end, 0
            k = right[j]
            right[i] = k
            if k < n:
                left[k] = i
                r = ranks.get(piece[i : ends[k]])
                if r is not None:
                    push(queue, (r, i, ends[k]))
            h = left[i]
            if h >= 0:
                r = ranks.get(piece[h:end])
                if r is not None:
                    push(queue, (r, h, end))
        return [ranks[piece[i : ends[i]]] for i in range(n) if ends[i]]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        memo, find, merge = self.memo, self.split.findall, self.merge
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            found = []
            for p in find(text):
                ids = memo.get(p)
                if ids is None:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    ids = memo[p] = merge(p.encode())
                found += ids
            sizes[k] = len(found)
            parts.append(np.array(found, np.int32))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lens) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        out = self.bytes[np.arange(total) + np.repeat(self.starts[ids] - (ends - lens), lens)]
        return out, np.concatenate([[0], ends])[offsets]


_loaded: dict[tuple[str, str], Bpe] = {}


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def load(path: str = RANKS, pattern: str = PATTERN, data: bytes | None = None) -> Bpe:
    """The vocabulary of a rank file, read once in a process; data is the file's content where it isn't at hand."""
    key = (path, pattern)
    if key not in _loaded:
        _loaded[key] = Bpe(path, pattern, data)
    return _loaded[key]


def _ids_column(ids: np.ndarray, offsets: np.ndarray, nulls: np.ndarray) -> pa.Array:
    out = list_array(ids, offsets, pa.int32())
    if nulls.any():
        out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(nulls, False)), pa.array(ids, pa.int32()))
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, pattern: str = PATTERN, check: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens); with check also round_trip: the ids decode to the text's bytes."""

    ranks = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern, ranks.value)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                col = part.column(1)
                nulls = col.is_null().to_numpy(zero_copy_only=False)
                ids, off = bpe.encode_many(col.to_pylist())
                cols = [part.column(0), _ids_column(ids, off, nulls), pa.array(np.diff(off), pa.int64(), mask=nulls)]
                names = ["doc_id", "ids", "n_tokens"]
                if check:
                    out, back = bpe.decode_many(ids, off)
                    data, want = text_bytes(col)
                    same = np.diff(back) == np.diff(want)
                    if same.all():
                        wrong = np.flatnonzero(out != data)
                        same[np.searchsorted(want, wrong, side="right") - 1] = False
                    else:
                        same = np.array([bytes(out[back[i] : back[i + 1]]) == bytes(data[want[i] : want[i + 1]]) for i in range(len(same))])
                    cols.append(pa.array(same, pa.bool_(), mask=nulls))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, ids array<int>, n_tokens long" + (", round_trip boolean" if check else "")
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) from lists of ids."""

    ranks = encoded.sparkSession.sparkContext.broadcast(read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern, ranks.value)
        for b in batches:
            col = b.column(1)
            nulls = col.is_null().to_numpy(zero_copy_only=False)
            col = col.filter(col.is_valid()) if nulls.any() else col
            flat = col.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            sizes = np.zeros(len(nulls), np.int64)
            sizes[~nulls] = col.value_lengths().to_numpy(zero_copy_only=False) if len(col) else 0
            data, off = bpe.decode_many(flat.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            text = string_array(data, off)
            try:
                text.validate(full=True)
            except pa.ArrowInvalid:
                text = pa.array([bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace") for i in range(len(nulls))], pa.string())
            if nulls.any():
                text = pa.array([None if z else t for z, t in zip(nulls, text.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.string())], names=["doc_id", "text"])

    return encoded.select(quoted(id_col).cast("long").alias("doc_id"), quoted(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), check=True)
