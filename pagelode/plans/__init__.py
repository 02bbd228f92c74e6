"""Registered queries, by family."""

from __future__ import annotations

import importlib

FAMILIES = ("general", "facts", "scoring", "text", "search", "series", "agreement", "models", "streams", "audits", "selection", "files")


def registry() -> tuple[dict, dict]:
    """All queries of the library's core and their SQL."""
    queries, oracles = {}, {}
    for name in FAMILIES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
