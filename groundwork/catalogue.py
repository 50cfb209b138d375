"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import corpus, curation, extraction, pages, places, release, runs, search, service, validation  # noqa: F401  registering their queries
from .plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
