"""Registered queries of the polyline and voxel operators."""

from __future__ import annotations

from . import history, lines, space, volumes
from .base import Query

MODULES = (lines, space, volumes, history)


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in m.plan.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.plan.sql.items()}
