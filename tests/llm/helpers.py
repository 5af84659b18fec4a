"""Small tables with everything that may go wrong in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """A documents table of (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, words=2000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, a null id."""
    long = prose(1, 60_000)
    rows = [
        (1, "", "en", "s", 0), (2, None, None, None, None), (None, "lost words here", "en", None, 3), (3, "   \n\t ", "en", "s", 6), (4, long, "de", "s", len(long)),
        (5, "same row", "en", "s", 8), (5, "same row", "en", "s", 8), (6, "é\U0001f600\x00 ünï", None, "s", 9), (7, "x" * 300_000, "fr", "s", 300_000), (8, "\n\n\n", "es", "s", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """df with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["th", "sig", "key", "k_doc", "k_th", "k_digest", "g_doc", "g_th", "r_doc", "r_th", "r_runs", "l_digest", "l_doc", "runs", "elements", "n", "digest", "keep", "score", "low_text", "shard", "piece", "a", "b", "v", "root", "y", "x", "w", "ids", "dotted.name"]
    return df.withColumns({c: F.lit(i) for i, c in enumerate(names)})
