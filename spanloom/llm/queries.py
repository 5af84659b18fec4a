"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from spanloom.llm import bpe, chat, exact_dedup, jaccard, license_scan, line_dedup, media, packing, quality, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_bpe": bpe.query,
    "op3_chat_format": chat.query,
    "op4_packing": packing.query,
    "op5_media": media.query,
    "op6_license_scan": license_scan.query,
    "op7_quality": quality.query,
    "op8_ngram_jaccard": jaccard.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_toxicity": toxicity.query,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op3_chat_format": chat.SQL,
    "op4_packing": packing.SQL.replace("{docs}", "documents"),
    "op8_ngram_jaccard": jaccard.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
