"""Labelled rows for the two trained classifiers, and the choice of thresholds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import quoted
from spanloom.plans.session import drop_scratch, materialize


def sample(labels: DataFrame, target: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """At most limit labelled ids, (doc_id, y), by the order of a hash of the id.

    The bound concerns fitting alone. Null ids and labels are left out; an id with several
    labels counts once, with the highest.
    """
    named = labels.select(quoted(id_col).cast("long").alias("doc_id"), quoted(target).cast("int").alias("y"))
    one = named.where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def one_row_each(rows: DataFrame) -> DataFrame:
    """Of the rows of each doc_id, which all have text, the one whose text has the least hash."""
    others = [c for c in rows.columns if c != "doc_id"]
    h = F.xxhash64("text")
    return rows.groupBy("doc_id").agg(*(F.min_by(c, h).alias(c) for c in others)).select(rows.columns)


def collected(rows: DataFrame, data: str, limit: int) -> pa.Table:
    """Rows (doc_id, .., data), at most limit bytes of data, by doc_id.

    The rows are written first; their sizes decide which come to the driver: each, in the order of
    a hash of the id, that the bytes left have room for. rows holds one of each doc_id.
    """
    written = materialize(rows, "training-rows")
    sizes = written.select("doc_id", F.xxhash64("doc_id").alias("h"), F.coalesce(F.octet_length(data), F.lit(0)).alias("b")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    room, chosen = limit, []
    for i, b in zip(sizes.column("doc_id").to_pylist(), sizes.column("b").to_pylist(), strict=True):
        if b <= room:
            chosen.append((i,))
            room -= b
    if len(chosen) < sizes.num_rows:
        ids = rows.sparkSession.createDataFrame(chosen, "doc_id long")
        got = written.join(F.broadcast(ids), "doc_id", "left_semi").toArrow()  # no more ids than labelled rows were asked for
    else:
        got = written.toArrow()
    drop_scratch(rows.sparkSession, written)
    return got.sort_by([("doc_id", "ascending")])


def shrunk(own: float, pooled: float, n: int, strength: float) -> float:
    """A group's own threshold drawn towards the pooled one, the more so the fewer rows (n) it rests on; by log-odds."""
    a, b = (math.log(max(x, 1e-9) / max(1 - x, 1e-9)) for x in (own, pooled))
    z = (n * a + strength * b) / (n + strength)
    return 1 / (1 + math.exp(-z))


def best_threshold(scores: np.ndarray, positive: np.ndarray, default: float, beta: float = 0.5) -> float:
    """The cut with the highest F-beta for score >= cut, amid the gap to the next score; default without both classes.

    A beta below 1 weighs precision more: what is rejected wrongly is lost.
    """
    if positive.all() or not positive.any():
        return default
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], positive[order].astype(float)
    hits, n = np.cumsum(y), np.arange(1, len(y) + 1)
    f = (1 + beta * beta) * hits / (n + beta * beta * y.sum())
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    k = int(ends[np.argmax(f[ends])])
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float((s[k] + below) / 2)
