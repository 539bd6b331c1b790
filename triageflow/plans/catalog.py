"""Imports every query module so the registry is complete."""

from __future__ import annotations

from triageflow.plans import queries  # noqa: F401
from triageflow.plans import metric_queries  # noqa: F401
from triageflow.plans.registry import QUERIES, Query


def registered() -> dict[str, Query]:
    return dict(QUERIES)
