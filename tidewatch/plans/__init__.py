"""Queries over the given tables, each with the SQL it is checked against."""

from __future__ import annotations

import importlib

from tidewatch.plans import tables

MODULES = ("logs", "status", "registry", "gating", "replay", "streams")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidewatch.plans.{name}")


def all_queries() -> dict[str, tables.Query]:
    _load()
    return dict(tables.QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(tables.ORACLES)
