"""Queries of the training-data operators, one for each, over its whole table."""

from __future__ import annotations

from vecloom.llm import embedding, langid, mixing, packing, records, repetition, sharding, simhash, substring, tokens

_MODULES = {
    "op1_best_fit_packing": packing,
    "op2_token_counts": tokens,
    "op3_mixing": mixing,
    "op4_simhash_near_dedup": simhash,
    "op5_substring_dedup": substring,
    "op6_sharding": sharding,
    "op7_repetition_rules": repetition,
    "op8_embedding_near_dedup": embedding,
    "op9_language_id": langid,
    "op10_token_records": records,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()} | {"op5_substring_dedup_every_run": substring.query_every_run}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if module.ORACLE_SQL}
