"""Every operator as a query over the given tables, with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("log_queries", "label_queries", "eval_queries", "load_queries", "text_queries", "stream_queries")


def catalog() -> dict:
    """name -> (callable of (spark, folder), SQL or None)."""
    merged: dict = {}
    for module in MODULES:
        for name, entry in import_module(f"tidemark.catalog.{module}").Q.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = entry
    return merged
