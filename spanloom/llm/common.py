"""Column bookkeeping and Arrow batch helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.plans.session import ship

#: Text bytes that one numpy pass works on; a longer document is a pass of its own.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use, for working columns beside the caller's own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """The column of that literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def named_apart(df: DataFrame, other: DataFrame) -> DataFrame:
    """other with its columns renamed where df has the same names, whatever their case."""
    out = other
    for c in other.columns:
        new = fresh(df, c)
        if new != c:
            out = out.withColumnRenamed(c, new)
    return out


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give memory that was freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Run, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow by workers that release what they freed at a task's end: they wait for the next one beside other steps."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(lean, schema)


def map_rows(df: DataFrame, run: Run) -> DataFrame:
    """df.mapInArrow to rows of the same columns, which run finds by their places: names may hold anything."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return map_batches(plain, run, plain.schema).toDF(*df.columns)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty; offsets start at 0 and have len+1 entries."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if not (pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)):
        width, kind = 4, np.int32
    else:
        width, kind = 8, np.int64
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=kind, count=n + 1, offset=arr.offset * width).astype(np.int64)
    if bufs[2] is None:
        return np.zeros(0, np.uint8), off - off[0]
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of arr with at most limit bytes of text each, one row at least."""
    _, off = text_bytes(arr)
    n, a = len(arr), 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def string_array(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over one buffer of UTF-8 bytes."""
    if len(parts) > 2**31 - 1:
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(parts))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(parts))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
