"""The queries of this subpackage and their SQL, module by module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_quality_rules", "op2_token_counts", "op3_jaccard_join", "op4_toxicity", "op5_bpe", "op6_secrets", "op7_packing", "op8_importance", "op9_training_order", "op10_fingerprints", "op11_url_filter", "op12_divergence", "op13_delta_lloyd")


def _all(attribute: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"seqloom.llm.{m}"), attribute).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
