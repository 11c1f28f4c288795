"""All registered queries (one per operator of the inventory)."""

from __future__ import annotations

import importlib

from .registry import REGISTRY, query

_MODULES = ["q_pages", "q_text", "q_log", "q_findings", "q_stream"]
_loaded = False


def registry():
    global _loaded
    if not _loaded:
        from .flagship import flagship, flagship_sql
        query("flagship_audit", flagship_sql)(lambda spark, d: flagship(spark, d))
        for m in _MODULES:
            try:
                importlib.import_module(f"veilscan.plans.{m}")
            except ModuleNotFoundError as e:
                if e.name != f"veilscan.plans.{m}":
                    raise
        _loaded = True
    return REGISTRY
