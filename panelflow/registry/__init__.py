"""Every operator as a query over the given tables, with the same result in plain SQL."""

from __future__ import annotations

from panelflow.registry import (  # noqa: F401  (each module adds its queries)
    aggregates,
    columns,
    filters,
    ingest,
    models,
    reshaping,
    scalars,
)
from panelflow.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
