"""All registered queries: name -> (Spark query, SQL twin or None)."""
from __future__ import annotations

from importlib import import_module

_MODULES = ("scalars", "filters", "merging", "reports", "landing", "state")


def catalog() -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(import_module(f"vacantia.plans.{name}").QUERIES)
    return out
