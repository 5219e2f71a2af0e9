"""Registered queries over the given tables and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = ["ingest", "series", "scoring", "selection", "blending", "learning", "live"]


def registry():
    for name in MODULES:
        import_module(f"catalog.{name}")
    from catalog.base import QUERIES, SQL

    return QUERIES, SQL
