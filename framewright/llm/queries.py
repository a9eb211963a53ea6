"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from . import conversation_repair, filter_audit, fingerprints, importance, language_id, lm_scoring, minhash_dedup, mixing, ngram_join, packing, quality_rules, substring_dedup, token_output

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_token_output": token_output.query,
    "op3_packing": packing.query,
    "op4_ngram_join": ngram_join.query,
    "op5_fingerprints": fingerprints.query,
    "op6_lm_scoring": lm_scoring.query,
    "op7_quality_rules": quality_rules.query,
    "op8_quality_classifier": importance.query,
    "op9_language_id": language_id.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_filter_audit": filter_audit.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_minhash_dedup": minhash_dedup.query,
}
ORACLES: dict[str, str] = {"op11_filter_audit": filter_audit.SQL}
