"""Queries of the training-data operators."""

from __future__ import annotations

from scholia.llm import chat_format, clustering, decontaminate, licenses, packing, quality_model, quality_rules, repeats, secrets, sharding, simhash, source_mix, vector_codes

MODULES = (licenses, quality_rules, repeats, quality_model, sharding, secrets, chat_format, simhash, source_mix, decontaminate, clustering, vector_codes, packing)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
