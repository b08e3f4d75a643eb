"""The screening run and the registered queries."""

from __future__ import annotations

import importlib

from porescreen.plans.registry import QUERIES, Query

_MODULES = (
    "sequence_queries", "assemble_queries", "score_queries", "voxel_queries", "channel_queries", "supplier_queries",
    "text_queries", "run_queries")


def load_queries() -> dict[str, Query]:
    """Import the query modules once and return the registry."""
    for module in _MODULES:
        importlib.import_module(f"porescreen.plans.{module}")
    return QUERIES
