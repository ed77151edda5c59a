"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from quarry.llm import collocations, decontamination, exact_dedup, filter_audit, language_id, lm_scoring, near_dedup, packing, pii, quality_mil, secrets, sharding, substring_dedup

_ENTRIES = {
    "op1_sharding": (sharding.op1_sharding, None),
    "op2_pii": (pii.op2_pii, None),
    "op3_packing": (packing.op3_packing, None),
    "op4_near_dedup": (near_dedup.op4_near_dedup, None),
    "op5_substring_dedup": (substring_dedup.op5_substring_dedup, None),
    "op6_secrets": (secrets.op6_secrets, None),
    "op7_exact_dedup": (exact_dedup.op7_exact_dedup, exact_dedup.OP7_SQL),
    "op8_language_id": (language_id.op8_language_id, None),
    "op9_decontamination": (decontamination.op9_decontamination, None),
    "op10_lm_scoring": (lm_scoring.op10_lm_scoring, None),
    "op11_quality": (quality_mil.op11_quality, None),
    "op12_collocations": (collocations.op12_collocations, collocations.OP12_SQL),
    "op13_filter_audit": (filter_audit.op13_filter_audit, filter_audit.OP13_SQL),
}


def queries():
    return {name: query for name, (query, _) in _ENTRIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ENTRIES.items() if sql}
