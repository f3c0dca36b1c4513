"""All queries of the temporal engine with their SQL oracles."""

from __future__ import annotations

from .queries import registry


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
