"""The registered queries of the engine itself and the SQL that says the same."""

from __future__ import annotations

from . import chat, checks, curation, relational, shapes, store, telemetry  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
