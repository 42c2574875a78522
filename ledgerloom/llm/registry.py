"""Queries of the corpus operators and their SQL counterparts, by name."""

from __future__ import annotations

from ledgerloom.llm import bpe, chat, exact_dedup, filter_audit, hard_negatives, language_id, license_scan, mixing, ngram_join, sharding, simhash, topk, url_filter

QUERIES = {
    "op1_shard_tree": sharding.query,
    "op2_chat_windows": chat.query,
    "op3_language_id": language_id.query,
    "op4_bpe": bpe.query,
    "op5_topk": topk.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_pfair_mix": mixing.query,
    "op8_url_filter": url_filter.query,
    "op9_license_scan": license_scan.query,
    "op10_simhash": simhash.query,
    "op11_filter_audit": filter_audit.query,
    "op12_ngram_join": ngram_join.query,
    "op13_hard_negatives": hard_negatives.query,
}

SQL: dict[str, str] = {
    "op5_topk": topk.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_url_filter": url_filter.sql(),
    "op11_filter_audit": filter_audit.SQL,
    "op12_ngram_join": ngram_join.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
