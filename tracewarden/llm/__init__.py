"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

#: query name -> module that defines a function of that name
_QUERIES = {
    "op1_language_id": "langid",
    "op2_personal_data": "pii",
    "op3_chat_formatting": "chat",
    "op4_document_fingerprints": "multiset",
    "op5_bpe_round_trip": "bpe",
    "op6_line_dedup": "linejoin",
    "op7_warc_archives": "warc",
    "op8_best_fit_packing": "packing",
    "op9_simhash_near_dedup": "simhash",
    "op10_nearest_neighbours": "mih",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tracewarden.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in dict.fromkeys(_QUERIES.values()):
        out |= getattr(importlib.import_module(f"tracewarden.llm.{module}"), "ORACLE_SQL", {})
    return out
