"""Queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from corvane.llm import (
    chat,
    decontaminate,
    fill_in_middle,
    hard_negatives,
    licenses,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    substrings,
    token_files,
    url_filters,
)

OPERATORS = {
    "op1_mixing_sources": mixing,
    "op2_url_filters": url_filters,
    "op3_quality_rules": quality,
    "op4_token_files": token_files,
    "op5_substring_dedup": substrings,
    "op6_benchmark_decontamination": decontaminate,
    "op7_chat_formatting": chat,
    "op8_simhash_near_dedup": simhash,
    "op9_license_scans": licenses,
    "op10_sharding": sharding,
    "op11_fill_in_middle": fill_in_middle,
    "op12_hard_negatives": hard_negatives,
    "op13_best_fit_packing": packing,
}


def queries() -> dict:
    return {name: module.query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in OPERATORS.items() if module.ORACLE_SQL}
