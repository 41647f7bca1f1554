"""Registered queries over the driver's tables."""

from __future__ import annotations

from .registry import ORACLES, QUERIES, Query


def _load() -> None:
    from . import audit_queries, desk_queries, flow_queries, more_queries, pattern_queries, position_queries, store_queries, study_queries, technical_queries, view_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
