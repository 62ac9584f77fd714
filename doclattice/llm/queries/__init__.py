"""Queries of this subpackage; each module has NAME, query() and SQL (None where SQL can't express it)."""

from __future__ import annotations

import importlib

MODULES = [f"op{n}" for n in range(1, 11)]


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
