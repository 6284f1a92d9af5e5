"""All registered queries and their SQL oracles."""

from __future__ import annotations

from zonestats.plans import (  # noqa: F401  (importing registers the queries)
    reports_clean,
    reports_cluster,
    reports_dims,
    reports_io,
    reports_rank,
    reports_stats,
)
from zonestats.plans.registry import ORACLES, QUERIES, QueryFn


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
