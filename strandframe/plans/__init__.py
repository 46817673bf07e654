"""Registered queries: each pairs a Spark job with the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

SECTIONS = [
    "sequences",
    "counting",
    "filters",
    "tables",
    "embedding",
    "assignment",
    "samples",
    "learning",
    "datasets",
    "scoring",
    "comparison",
    "streams",
]


def load_all() -> tuple[dict, dict]:
    """Import every section and return (queries, sql)."""
    for section in SECTIONS:
        if find_spec(f"{__name__}.{section}"):
            import_module(f"{__name__}.{section}")
    from .registry import QUERIES, SQL

    return QUERIES, SQL
