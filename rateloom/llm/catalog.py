"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from rateloom.llm import decontam, langid, licenses, line_templates, mixing, quality, sharding, simhash, token_files, toxicity

QUERIES = {
    "op1_quality_outliers": quality.op1_quality_outliers,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_sharding": sharding.op5_sharding,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_simhash": simhash.op7_simhash,
    "op8_token_records": token_files.op8_token_records,
    "op9_language_id": langid.op9_language_id,
    "op10_line_templates": line_templates.op10_line_templates,
}

ORACLE_SQL = {
    "op4_decontamination": decontam.OP4_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op10_line_templates": line_templates.OP10_SQL,
}
