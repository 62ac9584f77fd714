"""All queries of the engine with their SQL."""

from __future__ import annotations

from . import jobs, layout, packing, tex, text  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL


def entry(spark, sf_dir):
    return QUERIES["entry_copy_translate"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
