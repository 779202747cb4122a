"""Queries over the driver's tables, each next to its DuckDB twin."""

from __future__ import annotations

import importlib

_MODULES = ("derived", "profile", "anomalies", "rules", "trust", "intel", "lineage", "catalog", "sources", "streams")


def load():
    """Import every query module once and return the registry."""
    registry = importlib.import_module("workbench.registry")
    for name in _MODULES:
        importlib.import_module(f"workbench.{name}")
    return registry
