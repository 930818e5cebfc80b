"""Registered queries of this subpackage and the SQL of those SQL can express."""

from __future__ import annotations

from . import op1_line_dedup, op2_license_scan, op3_substring_dedup, op4_quality_rules, op5_token_counts, op6_decontamination, op7_toxicity, op8_byte_bpe, op9_near_dedup, op10_pii

QUERIES = {
    "op1_line_dedup": op1_line_dedup.query,
    "op2_license_scan": op2_license_scan.query,
    "op3_substring_dedup": op3_substring_dedup.query,
    "op4_quality_rules": op4_quality_rules.query,
    "op5_token_counts": op5_token_counts.query,
    "op6_decontamination": op6_decontamination.query,
    "op7_toxicity": op7_toxicity.query,
    "op8_byte_bpe": op8_byte_bpe.query,
    "op9_near_dedup": op9_near_dedup.query,
    "op10_pii": op10_pii.query,
}

ORACLE_SQL: dict[str, str] = {"op2_license_scan": op2_license_scan.oracle_sql(), "op6_decontamination": op6_decontamination.oracle_sql(), "op9_near_dedup": op9_near_dedup.oracle_sql()}
