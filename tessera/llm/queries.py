"""The queries of the numbered operators and the SQL that checks them, where SQL can."""

from __future__ import annotations

from . import (
    benchmark_windows, binary_packing, dominance_packing, exact_dedup, filter_audit, language_id, partenum_join, phrase_automata,
    quality_rules, secret_ledger, sentence_pieces, sharding, url_rules,
)

QUERIES = {
    "op4_sentence_pieces": sentence_pieces.op4_sentence_pieces,
    "op2_packed_token_ids": binary_packing.op2_packed_token_ids,
    "op9_ngram_jaccard_join": partenum_join.op9_ngram_jaccard_join,
    "op7_language_id": language_id.op7_language_id,
    "op3_best_fit_packing": dominance_packing.op3_best_fit_packing,
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op8_secret_scans": secret_ledger.op8_secret_scans,
    "op5_url_filters": url_rules.op5_url_filters,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_phrase_automata": phrase_automata.op12_phrase_automata,
    "op13_benchmark_windows": benchmark_windows.op13_benchmark_windows,
}

SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op8_secret_scans": secret_ledger.OP8_SQL,
    "op5_url_filters": url_rules.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_phrase_automata": phrase_automata.OP12_SQL,
    "op13_benchmark_windows": benchmark_windows.OP13_SQL,
}
