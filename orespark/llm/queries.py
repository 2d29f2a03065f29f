"""The queries of this subpackage: name -> function of (spark, sf_dir); ORACLE: name -> SQL where it can express them."""

from __future__ import annotations

import importlib

#: Module of each query; each has QUERY(spark, sf_dir) and may have ORACLE.
MODULES = {
    "op1_ngram_jaccard_join": "q1",
    "op2_license_scan": "q2",
    "op3_token_counts": "q3",
    "op4_secret_scan": "q4",
    "op5_quality_rules": "q5",
    "op6_chat_format": "q6",
    "op7_pii": "q7",
    "op8_decontaminate": "q8",
    "op9_language_id": "q9",
    "op10_bpe_codec": "q10",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__package__}.{module}").QUERY for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
