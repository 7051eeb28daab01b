"""Registered queries of the operators of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from streakline.llm import (chat_format, conversation_trie, langid, license_scan, line_dedup, ngram_jaccard, packing,
                            period_runs, pii, quality, quality_model, suffix_dedup, winnowing)

QUERIES = {
    "op1_quality_divergence": quality.query,
    "op2_chat_trees": chat_format.query,
    "op3_ngram_jaccard": ngram_jaccard.query,
    "op4_license_compression": license_scan.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_winnowing": winnowing.query,
    "op7_language_evidence": langid.query,
    "op8_variable_packing": packing.query,
    "op9_line_spread": line_dedup.query,
    "op10_pii_boosting": pii.query,
    "op11_prefix_trie": conversation_trie.query,
    "op12_quality_network": quality_model.query,
    "op13_period_runs": period_runs.query,
}
ORACLES = {
    "op2_chat_trees": chat_format.ORACLE,
    "op3_ngram_jaccard": ngram_jaccard.ORACLE,
    "op6_winnowing": winnowing.ORACLE,
    "op9_line_spread": line_dedup.ORACLE,
    "op11_prefix_trie": conversation_trie.ORACLE,
}
