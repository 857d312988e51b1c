"""Registered queries of the text operators: name -> (Spark query, SQL twin or None)."""
from __future__ import annotations

from importlib import import_module

_MODULES = ("url_filter", "parity_join", "quality_rules", "toxicity", "html_main", "gam_quality", "decontaminate", "line_dedup", "sharding", "packing", "mixing", "merkle", "hard_negatives")


def catalog() -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(import_module(f"vacantia.llm.{name}").QUERIES)
    return out
