"""Registered queries and their checking SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with a QUERIES and an SQL table.
MODULES = ("problems", "matching", "decisions", "replays", "catalogs", "studies")


def _tables(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"lodestone.queries.{m}"), name).items()}


def all_queries() -> dict:
    return _tables("QUERIES")


def all_sql() -> dict:
    return _tables("SQL")
