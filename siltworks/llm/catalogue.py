"""The pN_ queries and the SQL beside them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("overlap", "secrets", "grouping", "syntax", "provenance", "licences", "packing", "mixing", "level")


def _each():
    for m in MODULES:
        yield importlib.import_module(f"siltworks.llm.{m}")


def queries() -> dict[str, Callable]:
    return {k: f for m in _each() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _each() for k, s in m.SQL.items()}
