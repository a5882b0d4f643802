"""The numbered queries of this folder, each next to SQL that must agree where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "capture_archive",
    "quality_ratio",
    "url_rules",
    "blob_ledger",
    "exact_runs",
    "near_forest",
    "curve_shards",
    "suffix_repeats",
    "piece_agenda",
    "bin_slack",
    "word_exchange",
    "word_pointers",
    "active_lloyd",
)


def catalog() -> dict:
    """name -> (callable of (spark, folder), SQL or None)."""
    merged: dict = {}
    for module in MODULES:
        merged |= import_module(f"tidemark.llm.{module}_query").Q
    return merged
