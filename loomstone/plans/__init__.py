"""The registered queries and their SQL."""

from __future__ import annotations

from loomstone.plans import pipelines, relational, similar, texts

_catalogs = (relational.catalog, texts.catalog, similar.catalog, pipelines.catalog)


def queries() -> dict:
    return {k: v for c in _catalogs for k, v in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for c in _catalogs for k, v in c.sql.items()}
