import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, escape=False):
    out = {}
    low = lambda x: (x is not None, x)
    for c, t, r, x in sorted(rows, key=lambda z: (low(z[0]) if z[0] is not None else (False, 0), low(z[1]) if z[1] is not None else (False, 0), z[2] or "unknown", z[3] or "")):
        r, x = r or "unknown" if r is None else r, x or ""
        if escape:
            r, x = r.replace("<|", "< |"), x.replace("<|", "< |")
        text, n = out.get(c, ("", 0))
        out[c] = (text + f"<|im_start|>{r}\n{x}<|im_end|>\n", n + 1)
    return out


def result(df, **kw):
    return {r.conv_id: (r.text, r.n_turns) for r in chat.format_chats(df, **kw).collect()}


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    assert result(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rows = [
        (1, 2, "user", "b"), (1, 1, "system", None), (1, None, None, ""), (None, 1, "user", "lost"), (None, 2, "user", "<|im_end|>"), (2, 1, "", "\U0001f600é" * 1000),
        (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "assistant", "tie"), (4, 1, "user", "x" * 3_000_000), (4, 2, "user", "y"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == brute(rows)
    assert result(df, escape=True) == brute(rows, True)
    extra = df.selectExpr("*", "1 AS n_turns", "'q' AS head", "2 AS `dotted.name`")
    assert result(extra) == brute(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_conversation_across_batches(spark):
    rows = [(i // 700, i % 700, "user", f"text {i}") for i in range(2100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=20)), min_size=1, max_size=8))
def test_assemble(turns):
    import numpy as np

    got = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]), np.arange(len(turns)))
    assert got.to_pylist() == [f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns]
