"""Every query of the engine with its SQL twin."""

from __future__ import annotations

from . import evaluation, metadata, search, spans, text  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
