"""All registered queries of the radar operators, and their SQL."""

from __future__ import annotations

from sweepframe.plans import catalog, catalog_logs, catalog_recorded  # noqa: F401  (the others add to the catalog)


def queries() -> dict:
    return dict(catalog._queries)


def oracle_sql() -> dict[str, str]:
    return dict(catalog._sql)
