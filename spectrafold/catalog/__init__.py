"""Registered queries over the driver tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import importlib

from spectrafold.catalog.registry import REGISTRY

MODULES = (
    "tables", "scalars", "aggregates", "windows", "waves", "levels", "number_theory", "channels", "graphs", "trees", "validation", "streams", "sqlaccess", "neighbours",
)

for _module in MODULES:
    importlib.import_module(f"spectrafold.catalog.{_module}")

__all__ = ["REGISTRY"]
