"""All queries of the statistics operators."""

from __future__ import annotations

from .plans import audit, design, domain, formats, joins, ladder, models, reliability, scores, structure, units  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
