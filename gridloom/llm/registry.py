"""Names of the corpus queries and their SQL."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_decontamination": "decontamination",
    "op2_license_scan": "license_scan",
    "op3_packing": "packing",
    "op4_exact_dedup": "exact_dedup",
    "op5_toxicity": "toxicity",
    "op6_simhash_dedup": "simhash_dedup",
    "op7_suffix_dedup": "suffix_dedup",
    "op8_secret_scan": "secret_scan",
    "op9_token_counts": "token_counts",
    "op10_line_dedup": "line_dedup",
}


def _modules() -> dict:
    return {name: importlib.import_module(f"{__package__}.{module}") for name, module in _MODULES.items()}


def queries() -> dict:
    return {name: module.query for name, module in _modules().items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in _modules().items() if getattr(module, "SQL", None)}
