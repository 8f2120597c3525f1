"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import importlib

# query name -> module; the function has the query's name
MODULES = {
    "op1_best_fit_packing": "packing",
    "op2_mixing": "mixing",
    "op3_minhash_near_dedup": "near_dedup",
    "op4_html_extraction": "html_extract",
    "op5_lm_scoring": "lm_score",
    "op6_language_id": "language_id",
    "op7_quality_rules": "quality_rules",
    "op8_quality_classifier": "quality_classifier",
    "op9_token_binary_output": "token_store",
    "op10_embedding_dedup": "embedding_dedup",
    "op11_conversation_prefix_trie": "prefix_trie",
    "op12_bpe_transducer": "bpe_transducer",
    "op13_embedding_whitening": "whitening",
}


def _call(module: str, name: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"tessera.llm.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    found = {name: _call(module, name) for name, module in MODULES.items()}

    def pipeline(spark, sf_dir):
        import corpus_pipeline

        return corpus_pipeline.run(spark, sf_dir)

    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"tessera.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
