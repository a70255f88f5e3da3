"""Every registered query with its SQL twin, grouped by subject."""

from __future__ import annotations

from importlib import import_module

_GROUPS = ("relevance", "claims", "evidence", "offers", "market", "leads", "drafts", "ingest", "streams")


def all_queries() -> dict:
    found: dict = {}
    for group in _GROUPS:
        found.update(import_module(f"{__name__}.{group}").QUERIES)
    return found
