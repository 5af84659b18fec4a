"""Chat formatting: conversations rendered by columnar byte assembly.

Each turn becomes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Turns of a conversation are
brought together by one shuffle on conv_id and sorted by turn inside the partition. Per
Arrow batch, numpy takes the lengths of all segments (constant headers, roles, texts),
turns them into cumulative offsets and scatters the bytes of each column into one
preallocated buffer, which becomes the string column as it is: no Python string is made.
A conversation that runs on past its batch waits, as columns, for the next one.

Defined results
- A null role is written as ``unknown``, a null or empty text as nothing.
- Rows of a null conv_id form one conversation with a null id.
- Turns are ordered by turn (nulls first), then role, then text; equal rows are all written.
- Delimiters that occur in a text are written as they are unless ``escape`` is set, which
  breaks each ``<|`` into ``< |`` in roles and texts.
- An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import quoted, string_array, table, text_bytes

HEAD, MID, TAIL = b"<|im_start|>", b"\n", b"<|im_end|>\n"


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment i of data to out[at[i]:]."""
    lens = np.diff(offsets)
    if len(data):
        out[np.arange(len(data)) + np.repeat(at - offsets[:-1], lens)] = data


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, head: bytes = HEAD, mid: bytes = MID, tail: bytes = TAIL) -> pa.Array:
    """One string per conversation; first holds the row at which each begins."""
    rb, ro = text_bytes(roles)
    tb, to = text_bytes(texts)
    rl, tl = np.diff(ro), np.diff(to)
    size = len(head) + rl + len(mid) + tl + len(tail)
    end = np.cumsum(size)
    start = end - size
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for piece, at in ((head, start), (mid, start + len(head) + rl), (tail, end - len(tail))):
        if piece and len(at):
            out[(at[:, None] + np.arange(len(piece))).ravel()] = np.tile(np.frombuffer(piece, np.uint8), len(at))
    _scatter(out, start + len(head), rb, ro)
    _scatter(out, start + len(head) + rl + len(mid), tb, to)
    return string_array(out, np.concatenate([start[first], end[-1:]]))


def _flush(t: pa.Table, id_type: pa.DataType) -> pa.RecordBatch:
    t = t.combine_chunks()
    ids, n = t.column(0).combine_chunks(), t.num_rows
    codes = pc.fill_null(ids.dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    turns = np.diff(np.concatenate([first, [n]]))
    out = assemble(t.column(1).combine_chunks(), t.column(2).combine_chunks(), first)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)).cast(id_type), out.cast(pa.string()), pa.array(turns, pa.int64())], names=["conv_id", "text", "n_turns"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def same(a: pa.Scalar, b: pa.Scalar) -> bool:
        return a.as_py() == b.as_py()

    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0)
        if held and not same(held[-1].column(0)[-1], ids[0]):
            yield _flush(pa.Table.from_batches(held), pa.int64())
            held = []
        codes = pc.fill_null(ids.dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
        if last:
            yield _flush(pa.Table.from_batches([*held, b.slice(0, last)]), pa.int64())
            held = []
        held.append(b.slice(last))
    if held:
        yield _flush(pa.Table.from_batches(held), pa.int64())


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", escape: bool = False) -> DataFrame:
    """One row per conversation: (conv_id, text, n_turns)."""

    def clean(c):
        return F.replace(c, F.lit("<|"), F.lit("< |")) if escape else c

    t = turns.select(
        quoted(conv_col).cast("long").alias("conv_id"),
        clean(F.coalesce(quoted(role_col).cast("string"), F.lit("unknown"))).alias("role"),
        clean(F.coalesce(quoted(text_col), F.lit(""))).alias("text"),
        quoted(turn_col).cast("long").alias("turn"),
    )
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.select("conv_id", "role", "text").mapInArrow(_format, "conv_id long, text string, n_turns long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
SELECT conv_id,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text,
       count(*) AS n_turns
FROM conversations GROUP BY conv_id
"""
