"""Operators of a training-data pipeline, one module each, with the queries that apply them to whole tables."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "sharding",
    "mixing",
    "near_dedup",
    "chat",
    "pii",
    "decontaminate",
    "toxicity",
    "quality",
    "token_counts",
    "warc",
    "link_filter",
    "whitening",
    "lexical_search",
]


def registry():
    """Queries by name, and the SQL of those that SQL can express."""
    for name in MODULES:
        import_module(f"telespan.llm.{name}")
    from telespan.llm.base import QUERIES, SQL

    return QUERIES, SQL
