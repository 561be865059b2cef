"""Registered queries over the given tables, grouped as the operators are."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from docmill.session import ship_package

SECTIONS = ["search", "ingest", "catalog", "chat", "streaming"]


def _sections():
    return [import_module(f"docmill.plans.{name}") for name in SECTIONS]


def _shipped(query):
    @wraps(query)
    def run(spark, root):
        return query(ship_package(spark), root)

    return run


def all_queries() -> dict:
    """Every registered query. Each makes sure that the workers have the package."""
    return {k: _shipped(v) for section in _sections() for k, v in section.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for section in _sections() for k, v in section.ORACLES.items()}
