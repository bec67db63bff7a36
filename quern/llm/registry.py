"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from quern.llm import sql

#: module -> (query function, name of its SQL or None)
_MODULES = {
    "url_filter": ("op1_url_filter", "OP1_SQL"),
    "suffix_dedup": ("op2_suffix_dedup", "OP2_SQL"),
    "quality": ("op3_quality_rules", "OP3_SQL"),
    "mixing": ("op4_mixing", "OP4_SQL"),
    "minhash": ("op5_minhash", "OP5_SQL"),
    "exact_dedup": ("op6_exact_dedup", "OP6_SQL"),
    "pii": ("op7_pii", None),
    "passages": ("op8_passages", "OP8_SQL"),
    "packing": ("op9_packing", None),
    "html_extract": ("op10_html_extraction", None),
}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _module, (_name, _sql) in _MODULES.items():
    _loaded = importlib.import_module(f"quern.llm.{_module}")
    QUERIES[_name] = getattr(_loaded, _name)
    if _sql:
        ORACLE_SQL[_name] = getattr(_loaded, _sql, None) or getattr(sql, _sql)
